"""Column functions (FN-*): pure ``Column -> Column`` helpers built only on
``pyspark.sql.functions`` so every expression stays inside whole-stage codegen."""

from codelens.functions.scalar import (  # noqa: F401
    basename, clamp, dirname, duration_text, ext, first_truthy, hash_key, js_trim,
    parse_time, round_half_up,
)
from codelens.functions.severity import (  # noqa: F401
    normalize_severity, semgrep_severity, severity_bucket, severity_rank3,
    severity_weight,
)
from codelens.functions.status import (  # noqa: F401
    impact_rank, status_from_rank, status_rank, worst_of, worst_status,
)
from codelens.functions.text import tokenize, word_pattern  # noqa: F401
