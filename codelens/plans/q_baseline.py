"""Queries: baseline lookup, impact and the flagship top-impacted slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens import dims
from codelens.operators import baseline as B
from codelens.operators import score, topk
from codelens.plans import bindings as V
from codelens.plans.catalog import register

FD = V.feature_dim_sql()

# JOIN-01 + JOIN-04: features -> baseline status, per-browser support.
JOIN01_SQL = f"""
WITH f AS ({V.V_FEATURES_SQL})
SELECT f.scan_id, f.file, f.feature,
       coalesce(d.status, 'unknown') AS status,
       coalesce(d.status, 'unknown') AS chrome,
       coalesce(d.status, 'unknown') AS safari,
       CASE WHEN coalesce(d.status, 'unknown') = 'unknown'
            THEN 'No baseline mapping available (fallback)' ELSE '' END AS notes
FROM f LEFT JOIN {FD} d ON f.feature = d.feature
"""


@register("JOIN-01", JOIN01_SQL)
def q_join01(spark, sf_dir):
    b = B.lookup_baseline(V.v_features(spark, sf_dir), dims.feature_dim(spark))
    return b.select("scan_id", "file", "feature", "status",
                    F.col("support")["chrome"].alias("chrome"),
                    F.col("support")["safari"].alias("safari"), "notes")


def baseline_from_lookup(spark, sf_dir):
    return B.lookup_baseline(V.v_features(spark, sf_dir), dims.feature_dim(spark))


# AGG-13: impact per file.
IMPACT_SQL = f"""
WITH f AS ({V.V_FEATURES_SQL}),
b AS (SELECT f.scan_id, f.file, coalesce(d.status, 'unknown') AS status
      FROM f LEFT JOIN {FD} d ON f.feature = d.feature)
SELECT scan_id, file,
       CAST(sum(CASE status WHEN 'unsupported' THEN 3 WHEN 'partial' THEN 2 ELSE 1 END) AS BIGINT) AS score,
       CAST(sum(CASE WHEN status = 'unsupported' THEN 1 ELSE 0 END) AS BIGINT) AS unsupported,
       CAST(sum(CASE WHEN status = 'partial' THEN 1 ELSE 0 END) AS BIGINT) AS partial,
       count(*) AS total
FROM b GROUP BY scan_id, file
"""


@register("AGG-13", IMPACT_SQL)
def q_agg13(spark, sf_dir):
    return score.impact_by_file(baseline_from_lookup(spark, sf_dir))


# TOP-01 (flagship): top 15 impacted files per scan.
TOP01_SQL = f"""
WITH i AS ({IMPACT_SQL})
SELECT scan_id, file, score, unsupported, partial, total, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, file ASC) AS rank FROM i)
WHERE rank <= 15
"""


def flagship(spark, sf_dir):
    impact = score.impact_by_file(baseline_from_lookup(spark, sf_dir))
    return topk.top_impacted(impact, 15).select("scan_id", "file", "score", "unsupported", "partial",
                                                "total", F.col("rank").cast("long").alias("rank"))


register("TOP-01", TOP01_SQL)(flagship)

# JOIN-04 over stored snapshots: worst status of a per-browser support map.
# Support per browser is derived from the snapshot status so that all four
# ranks and the alias words (no / a / yes) occur.
JOIN04_SQL = f"""
WITH b AS ({V.V_BASELINE_SQL}),
s AS (SELECT scan_id, file, feature,
        status AS chrome,
        CASE status WHEN 'unsupported' THEN 'no' WHEN 'partial' THEN 'a' WHEN 'supported' THEN 'yes' ELSE 'unknown' END AS firefox,
        CASE WHEN length(file) % 2 = 0 THEN 'supported' ELSE 'partial' END AS safari
      FROM b)
SELECT scan_id, file, feature, chrome, firefox, safari,
  CASE greatest(
        CASE WHEN chrome IN ('unsupported','no','n') THEN 3 WHEN chrome IN ('partial','a') THEN 2 WHEN chrome IN ('supported','yes','y') THEN 1 ELSE 0 END,
        CASE WHEN firefox IN ('unsupported','no','n') THEN 3 WHEN firefox IN ('partial','a') THEN 2 WHEN firefox IN ('supported','yes','y') THEN 1 ELSE 0 END,
        CASE WHEN safari IN ('unsupported','no','n') THEN 3 WHEN safari IN ('partial','a') THEN 2 WHEN safari IN ('supported','yes','y') THEN 1 ELSE 0 END)
    WHEN 3 THEN 'unsupported' WHEN 2 THEN 'partial' WHEN 1 THEN 'supported' ELSE 'unknown' END AS worst
FROM s
"""


@register("JOIN-04", JOIN04_SQL)
def q_join04(spark, sf_dir):
    b = V.v_baseline(spark, sf_dir)
    st = F.col("status")
    s = b.select(
        "scan_id", "file", "feature",
        st.alias("chrome"),
        F.when(st == "unsupported", "no").when(st == "partial", "a").when(st == "supported", "yes")
        .otherwise("unknown").alias("firefox"),
        F.when(F.length("file") % 2 == 0, "supported").otherwise("partial").alias("safari"))
    support = F.create_map(F.lit("chrome"), F.col("chrome"), F.lit("firefox"), F.col("firefox"),
                           F.lit("safari"), F.col("safari"))
    return s.withColumn("worst", B.worst_of(F.map_values(support)))


# -- JOIN-02 / JOIN-03: fallbacks for features the mapping leaves unknown ------
def _fallback_cols(df):
    return df.select("scan_id", "file", "feature", "status",
                     *[F.col("support")[b].alias(b) for b in ("chrome", "firefox", "safari", "edge")], "notes")


def after_compat(spark, sf_dir):
    base = B.lookup_baseline(V.v_features(spark, sf_dir), dims.feature_dim(spark))
    return B.lookup_compat(base, dims.compat_aliases(spark), V.v_compat(spark, sf_dir))


from codelens import rules as _R  # noqa: E402

_ALIASES = ", ".join(f"('{f}', '{p}')" for f, p in _R.COMPAT_ALIASES.items())
_RANK = ("CASE WHEN {x} IN ('unsupported','no','n') THEN 3 WHEN {x} IN ('partial','a') THEN 2 "
         "WHEN {x} IN ('supported','yes','y') THEN 1 ELSE 0 END")


def _worst_sql(cols):
    g = "greatest(" + ", ".join(_RANK.format(x=f"lower(trim({c}))") for c in cols) + ")"
    return f"CASE {g} WHEN 3 THEN 'unsupported' WHEN 2 THEN 'partial' WHEN 1 THEN 'supported' ELSE 'unknown' END"


_NC = len(V.COMPAT_PATHS)
JOIN02_SQL = f"""
WITH f AS ({V.V_FEATURES_SQL}),
b AS (SELECT f.scan_id, f.file, f.feature, coalesce(d.status, 'unknown') AS status0 FROM f LEFT JOIN {FD} d ON f.feature = d.feature),
al AS (SELECT * FROM (VALUES {_ALIASES}) AS t(feature, path)),
raw AS (SELECT ({V.sql_list(V.COMPAT_PATHS)})[CAST(p_partkey % {_NC} AS INTEGER) + 1] AS path,
               ({V.sql_list(_R.BROWSERS)})[CAST((p_partkey // {_NC}) % 4 AS INTEGER) + 1] AS browser,
               {{'va': CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 'false' ELSE CAST(p_size AS VARCHAR) END,
                 'pi': p_size % 3 = 0, 'fl': p_size % 11 = 0, 'px': CASE WHEN p_size % 13 = 0 THEN '-webkit-' END}} AS e,
               p_partkey FROM part),
cp AS (SELECT path, browser, arg_max(e, p_partkey) AS e FROM raw GROUP BY path, browser),
cls AS (SELECT path, browser, CASE WHEN e.va IS NULL OR lower(e.va) = 'false' THEN 'unsupported' WHEN e.pi THEN 'partial'
                                   WHEN e.fl OR e.px IS NOT NULL THEN 'partial' ELSE 'supported' END AS st FROM cp),
res AS (SELECT al.feature, max(CASE WHEN browser = 'chrome' THEN st END) AS c, max(CASE WHEN browser = 'firefox' THEN st END) AS ff,
               max(CASE WHEN browser = 'safari' THEN st END) AS sa, max(CASE WHEN browser = 'edge' THEN st END) AS ed
        FROM al JOIN cls ON al.path = cls.path GROUP BY al.feature),
j AS (SELECT b.*, res.feature IS NOT NULL AND b.status0 = 'unknown' AS use_c,
             coalesce(res.c, 'unknown') AS c, coalesce(res.ff, 'unknown') AS ff, coalesce(res.sa, 'unknown') AS sa,
             coalesce(res.ed, 'unknown') AS ed
      FROM b LEFT JOIN res ON b.feature = res.feature)
SELECT scan_id, file, feature,
       CASE WHEN use_c THEN {_worst_sql(['c', 'ff', 'sa', 'ed'])} ELSE status0 END AS status,
       CASE WHEN use_c THEN c ELSE status0 END AS chrome, CASE WHEN use_c THEN ff ELSE status0 END AS firefox,
       CASE WHEN use_c THEN sa ELSE status0 END AS safari, CASE WHEN use_c THEN ed ELSE status0 END AS edge,
       CASE WHEN use_c THEN '' WHEN status0 = 'unknown' THEN 'No baseline mapping available (fallback)' ELSE '' END AS notes
FROM j
"""

_USE_W = "j2.status = 'unknown' AND hit.h IS NOT NULL"
JOIN03_SQL = f"""
WITH j2 AS ({JOIN02_SQL}),
keys AS (SELECT DISTINCT feature FROM j2 WHERE status = 'unknown'),
cat AS (SELECT p_partkey AS ord, ({V.sql_list(V.FEATURE_UNIVERSE)})[CAST(p_partkey % {V.N_FEATURES} AS INTEGER) + 1] AS k,
               p_name, p_size FROM part),
cat2 AS (SELECT ord, upper(k) || ' ' || p_name AS name, k || '-' || CAST(ord AS VARCHAR) AS slug,
                ({V.sql_list(V.STATUS_CYCLE)})[CAST(p_size % 4 AS INTEGER) + 1] AS wc,
                ({V.sql_list(V.STATUS_CYCLE)})[CAST((p_size // 4) % 4 AS INTEGER) + 1] AS ws FROM cat),
hit AS (SELECT keys.feature, arg_min({{'wc': wc, 'ws': ws, 'label': coalesce(slug, name)}}, ord) AS h
        FROM keys JOIN cat2 ON contains(lower(cat2.name), lower(keys.feature)) OR contains(lower(cat2.slug), lower(keys.feature))
        GROUP BY keys.feature)
SELECT j2.scan_id, j2.file, j2.feature,
       CASE WHEN {_USE_W} THEN {_worst_sql(["hit.h.wc", "'unknown'", "hit.h.ws", "'unknown'"])} ELSE j2.status END AS status,
       CASE WHEN {_USE_W} THEN hit.h.wc ELSE j2.chrome END AS chrome,
       CASE WHEN {_USE_W} THEN 'unknown' ELSE j2.firefox END AS firefox,
       CASE WHEN {_USE_W} THEN hit.h.ws ELSE j2.safari END AS safari,
       CASE WHEN {_USE_W} THEN 'unknown' ELSE j2.edge END AS edge,
       CASE WHEN {_USE_W} THEN 'Fallback from web-features for ' || chr(39) || hit.h.label || chr(39) ELSE j2.notes END AS notes
FROM j2 LEFT JOIN hit ON j2.feature = hit.feature
"""


@register("JOIN-02", JOIN02_SQL)
def q_join02(spark, sf_dir):
    return _fallback_cols(after_compat(spark, sf_dir))


@register("JOIN-03", JOIN03_SQL)
def q_join03(spark, sf_dir):
    return _fallback_cols(B.lookup_web_features(after_compat(spark, sf_dir), V.v_web_features(spark, sf_dir)))
