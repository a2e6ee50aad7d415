"""Queries: column functions (FN-01..08) over driver tables, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelens import functions as FN
from codelens.plans import bindings as V
from codelens.plans.catalog import register

FN01_SQL = """
SELECT l_orderkey, l_linenumber,
       CAST(floor(l_discount * 100 - 5 + 0.5) AS BIGINT) AS rounded,
       least(greatest(l_quantity - 25, 0), 10) AS clamped,
       CAST(floor(l_tax * 100) AS BIGINT) AS floored, CAST(ceil(l_tax * 100) AS BIGINT) AS ceiled, round(sqrt(l_quantity), 6) AS root
FROM lineitem
"""


@register("FN-01", FN01_SQL)
def q_fn01(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     FN.round_half_up(F.col("l_discount") * 100 - 5).cast("long").alias("rounded"),
                     FN.clamp(F.col("l_quantity") - 25, 0, 10).alias("clamped"),
                     F.floor(F.col("l_tax") * 100).alias("floored"), F.ceil(F.col("l_tax") * 100).alias("ceiled"),
                     F.round(F.sqrt("l_quantity"), 6).alias("root"))


FN02_SQL = """
SELECT p_partkey, lower(trim(p_name)) AS low, split_part(p_name, ' ', 1) AS first_word,
       replace(p_type, 'ECONOMY', 'ECO') AS replaced, starts_with(p_brand, 'Brand#1') AS starts,
       contains(p_name, 'ring') AS includes, substr(p_name, 1, 3) AS head,
       array_to_string([p_brand, p_type], '|') AS joined
FROM part
"""


@register("FN-02", FN02_SQL)
def q_fn02(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.lower(F.trim("p_name")).alias("low"),
                    F.split("p_name", " ")[0].alias("first_word"),
                    F.replace("p_type", F.lit("ECONOMY"), F.lit("ECO")).alias("replaced"),
                    F.col("p_brand").startswith("Brand#1").alias("starts"), F.col("p_name").contains("ring").alias("includes"),
                    F.substring("p_name", 1, 3).alias("head"), F.array_join(F.array("p_brand", "p_type"), "|").alias("joined"))


FN03_SQL = """
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') AS p FROM pages)
SELECT page_id, p AS path,
       CASE WHEN contains(p, '/') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir,
       regexp_extract(p, '[^/]*$', 0) AS base,
       lower(regexp_extract(regexp_extract(p, '[^/]*$', 0), '^.+(\\.[^.]*)$', 1)) AS ext
FROM u
"""


@register("FN-03", FN03_SQL)
def q_fn03(spark, sf_dir):
    pg = V.table(spark, sf_dir, "pages")
    p = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return pg.select("page_id", p.alias("path"), FN.dirname(p).alias("dir"), FN.basename(p).alias("base"),
                     FN.ext(p).alias("ext"))


FN04_SQL = """
SELECT event_id, CAST(ts AS TIMESTAMP) AS parsed,
       CASE WHEN floor(value + 0.5) >= 60 THEN CAST(CAST(floor(floor(value + 0.5) / 60) AS BIGINT) AS VARCHAR) || 'm '
            || CAST(CAST(floor(value + 0.5) AS BIGINT) % 60 AS VARCHAR) || 's'
            ELSE CAST(CAST(floor(value + 0.5) AS BIGINT) % 60 AS VARCHAR) || 's' END AS duration
FROM events
"""


@register("FN-04", FN04_SQL)
def q_fn04(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return ev.select("event_id", FN.parse_time(iso).cast("timestamp_ntz").alias("parsed"),
                     FN.duration_text(F.col("value")).alias("duration"))


FN05_SQL = """
SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list(string_split(role || ',' || CAST(turn % 3 AS VARCHAR), ','))))), ',') AS items,
       bool_or(role = 'user') AS has_user, CAST(len(list(turn)) AS INTEGER) AS n
FROM conversations GROUP BY conv_id
"""


@register("FN-05", FN05_SQL)
def q_fn05(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    parts = F.split(F.concat_ws(",", "role", (F.col("turn") % 3).cast("string")), ",")
    g = c.groupBy("conv_id").agg(F.collect_list(parts).alias("ps"), F.collect_list("turn").alias("ts"))
    return g.select("conv_id", F.array_join(F.array_sort(F.array_distinct(F.flatten("ps"))), ",").alias("items"),
                    F.exists(F.flatten("ps"), lambda x: x == "user").alias("has_user"), F.size("ts").alias("n"))


FN06_SQL = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       '{"id":' || CAST(event_id AS VARCHAR) || ',"type":"' || event_type || '"}' AS doc
FROM events
"""


@register("FN-06", FN06_SQL)
def q_fn06(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
                     F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


FN07_SQL = "SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '|' || source) AS key FROM documents"


@register("FN-07", FN07_SQL)
def q_fn07(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", FN.hash_key(F.col("doc_id"), F.col("source")).alias("key"))


FN08_SQL = """
SELECT doc_id, coalesce(CASE WHEN q = 0 OR q IS NULL THEN NULL ELSE CAST(q AS VARCHAR) END, t, 'none') AS pick
FROM (SELECT d.doc_id, l.quality AS q, CASE WHEN l.toxic = 0 THEN NULL ELSE CAST(l.toxic AS VARCHAR) END AS t
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


@register("FN-08", FN08_SQL)
def q_fn08(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id")
    lab = V.table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select("doc_id", FN.first_truthy(F.col("quality").cast("string"), F.col("toxic").cast("string"),
                                              F.lit("none")).alias("pick"))
