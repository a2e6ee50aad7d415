"""The registered queries: one per operator ID, an oracle for each outside the corpus operators, and both sides' names agree."""

import re


def test_registry():
    import __spark_entry__ as E
    queries, oracle = E.queries(), E.oracle_sql()
    own = {n for n in queries if re.match(r"[A-Z]{2,4}-\d\d", n)}
    assert len(own) >= 168 and own <= set(oracle)
    assert set(oracle) <= set(queries)
    others = set(queries) - own
    assert all(re.match(r"op\d+_\w+$|pipeline$", n) for n in others)


def test_views_have_no_row_filters_by_key():
    """No view of part leaves rows out by their number."""
    from codelens.plans import bindings as V
    for sql in (V.V_CONFIGS_SQL, V.V_FRAMEWORKS_SQL, V.V_PACKAGES_SQL, V.V_ALLOWED_SQL):
        assert "WHERE" in sql and "%" not in sql.split("WHERE", 1)[1]
