"""One query per operator, over its whole table, with production parameters.

``QUERIES[name](spark, sf_dir)`` runs the operator; ``ORACLE[name]`` is DuckDB
SQL for the same rows where SQL can express them.  The others are held against
brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm import (decontamination, html_extraction, language_id, line_dedup, merkle_manifest, mixing, ngram_join,
                          quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_alignment)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = quality_classifier.train(docs, quality_labels(spark, sf_dir))
    scored = quality_classifier.score(docs, weights, bias, threshold=0.3)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


LINE_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS pos FROM lines
             WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS following FROM numbered),
later AS (SELECT *, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) AS copy FROM pairs WHERE following IS NOT NULL),
single AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM numbered
           WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 10),
whole AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy FROM documents) WHERE copy > 1),
gone AS (SELECT doc_id, pos FROM later WHERE copy > 1 UNION SELECT doc_id, pos + 1 FROM later WHERE copy > 1
         UNION SELECT doc_id, pos FROM single WHERE copy > 1 UNION SELECT doc_id, pos FROM numbered WHERE doc_id IN (SELECT doc_id FROM whole)),
kept AS (SELECT l.doc_id, sha256(string_agg(l.line, chr(10) ORDER BY l.no)) AS h
         FROM lines l LEFT JOIN numbered n ON n.doc_id = l.doc_id AND n.no = l.no
         WHERE (l.doc_id, coalesce(n.pos, -1)) NOT IN (SELECT doc_id, pos FROM gone) GROUP BY l.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM numbered n WHERE n.doc_id = d.doc_id) AS n_lines,
       (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed, coalesce(k.h, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op2_line_dedup", LINE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.delete_repeats(table(spark, sf_dir, "documents"), min_lines=2)
    return found.select("doc_id", "n_lines", "n_removed", "kept_sha256")


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_slots(table(spark, sf_dir, "documents"), shards=16)


# for items of five words or more, which all items of the table have
LEAK_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
ds AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM d, unnest(range(0, len(w) - 4)) AS t(p)),
sh AS MATERIALIZED (SELECT item_id, s, count(*) AS c FROM (
    SELECT item_id, array_to_string(w[p + 1:p + 5], ' ') AS s FROM i, unnest(range(0, len(w) - 4)) AS t(p)) GROUP BY ALL),
pairs AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN sh USING (s)),
windows AS (SELECT doc_id, item_id, len(i.w) - 4 AS m, least(len(i.w), len(d.w)) AS n, unnest(range(0, greatest(1, len(d.w) - len(i.w) + 1))) AS start
            FROM pairs JOIN d USING (doc_id) JOIN i USING (item_id)),
counted AS (SELECT w.doc_id, w.item_id, w.start, w.m, w.n, ds.s, count(*) AS c FROM windows w
            JOIN ds ON ds.doc_id = w.doc_id AND ds.p >= w.start AND ds.p <= w.start + w.n - 5 GROUP BY ALL),
scored AS (SELECT c.doc_id, c.item_id, c.start, c.m, c.n, sum(least(c.c, sh.c)) AS low FROM counted c
           JOIN sh ON sh.item_id = c.item_id AND sh.s = c.s GROUP BY ALL),
best AS (SELECT *, low / (m + n - 4 - low) AS similarity,
                row_number() OVER (PARTITION BY doc_id, item_id ORDER BY low / (m + n - 4 - low) DESC, start) AS place FROM scored)
SELECT doc_id, item_id, start AS start_word, n AS n_words, similarity FROM best WHERE place = 1 AND similarity >= 0.75
"""


@query("op4_decontamination", LEAK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.75)
    return leaks.select("doc_id", "item_id", "start_word", "n_words", "similarity")


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


SUFFIX_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
-- short pieces first: substr counts characters from the start of its string
piece AS MATERIALIZED (SELECT doc_id, n, q, substr(h, 2 * q + 1, 2 * 549) AS h FROM b, unnest(range(0, n, 500)) AS t(q)),
win AS MATERIALIZED (SELECT doc_id, q + k AS p, substr(h, 2 * k + 1, 100) AS s FROM piece, unnest(range(0, 500)) AS t(k) WHERE q + k + 50 <= n),
first AS (SELECT s, min(doc_id) AS doc_id FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
again AS MATERIALIZED (SELECT w.doc_id, w.p FROM win w JOIN first f ON f.s = w.s WHERE f.doc_id < w.doc_id),
bytes AS (SELECT doc_id, q + k AS p, substr(h, 2 * k + 1, 2) AS c FROM piece, unnest(range(0, 500)) AS t(k) WHERE q + k < n),
marked AS (SELECT x.doc_id, x.p, x.c, coalesce(x.p - a.p < 50, false) AS gone
           FROM bytes x ASOF LEFT JOIN again a ON a.doc_id = x.doc_id AND x.p >= a.p),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked),
told AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
                string_agg(c, '' ORDER BY p) FILTER (WHERE NOT gone) AS h FROM edges GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t.h, ''))) AS kept_sha256
FROM b LEFT JOIN told t ON t.doc_id = b.doc_id
"""


@query("op6_suffix_dedup", SUFFIX_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), length=50)


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
               FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
                   (ARRAY[5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
            FROM sized GROUP BY source),
steps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, source_size / weight AS r,
                 (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
          FROM sources WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT level FROM steps WHERE level * weight <= cap ORDER BY r, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM level) * weight), cap) AS target FROM steps),
shares AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
                  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
                  ((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE)
                  / 4503599627370496.0::DOUBLE AS u
           FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
odds AS (SELECT *, least(floor(ratio), 2)::BIGINT AS whole, ratio - least(floor(ratio), 2) AS p FROM shares),
ranked AS (SELECT *, target - (whole * source_size)::DOUBLE AS rest,
                  CASE WHEN u * (1 - p) + p * (1 - u) > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) ELSE 1.0 END AS rank
           FROM odds),
cut AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, u, doc_id NULLS FIRST, size
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN words_before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cut
"""


@query("op7_mixing", MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), total_share=1.5, max_copies=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


REPEAT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(p)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, p + k AS p FROM again, unnest(range(0, 35)) AS t(k)),
kept AS (SELECT x.doc_id, string_agg(x.w, ' ' ORDER BY x.p) AS t
         FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM d) x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p
         GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@query("op8_substring_dedup", REPEAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=35)


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.verdicts(docs, quality_rules.fit(docs, quality_labels(spark, sf_dir)))


NEAR_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
    SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
                          GROUP BY ALL) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b
    WHERE 100 * c >= 75 * (m.n + n.n - c)),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM words
    UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id JOIN reach r ON r.doc_id = w.doc_id GROUP BY ALL
"""


@query("op10_ngram_join", NEAR_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(table(spark, sf_dir, "documents"))


#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return token_alignment.link_statistics(table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs), with_spans=False)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# crc: the text's bits, lowest first, through the reflected polynomial (ids are ASCII)
MANIFEST_SQL = r"""
WITH RECURSIVE told AS (
    SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                  lambda c: list_transform(range(8), lambda b: (ascii(c)::BIGINT >> b) & 1)))),
                  lambda r, b: xor(r >> 1, CASE WHEN xor(r, b) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 7 = 0 AS wrong FROM documents),
leaves AS MATERIALIZED (
    SELECT doc_id, lang, wrong, n_chars, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || body) AS leaf,
           sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || body) AS other
    FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS before, coalesce(strlen(text) || ':' || text, '-') AS body FROM told)),
placed AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
tree AS (
    SELECT g, 0 AS level, p, n, leaf AS h FROM placed
    UNION ALL
    SELECT g, level + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tree WHERE n > 1 GROUP BY g, level, p // 2, n),
stored AS MATERIALIZED (SELECT * FROM tree),
top AS (
    SELECT 0 AS level, g AS p, (SELECT count(DISTINCT g) FROM placed) AS n, h FROM stored WHERE n = 1
    UNION ALL
    SELECT level + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM top WHERE n > 1 GROUP BY level, p // 2, n),
upper AS MATERIALIZED (SELECT * FROM top),
climb AS (
    SELECT doc_id, g, p AS leaf_no, 0 AS level, p, n, '' AS proof, CASE WHEN wrong THEN other ELSE leaf END AS h FROM placed
    UNION ALL
    SELECT c.doc_id, c.g, c.leaf_no, c.level + 1, c.p // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
           sha256(CASE WHEN c.p % 2 = 0 THEN c.h || coalesce(s.h, '') ELSE s.h || c.h END)
    FROM climb c LEFT JOIN stored s ON s.g = c.g AND s.level = c.level AND s.p = xor(c.p, 1) WHERE c.n > 1),
on_top AS (
    SELECT doc_id, g, leaf_no, 0 AS level, g AS p, (SELECT count(DISTINCT g) FROM placed) AS n, proof, h FROM climb WHERE n = 1
    UNION ALL
    SELECT c.doc_id, c.g, c.leaf_no, c.level + 1, c.p // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
           sha256(CASE WHEN c.p % 2 = 0 THEN c.h || coalesce(s.h, '') ELSE s.h || c.h END)
    FROM on_top c LEFT JOIN upper s ON s.level = c.level AND s.p = xor(c.p, 1) WHERE c.n > 1)
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = t.h AS verified
FROM placed l JOIN on_top o ON o.g = l.g AND o.leaf_no = l.p AND o.n = 1 JOIN stored r ON r.g = l.g AND r.n = 1 JOIN upper t ON t.n = 1
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle_manifest.audit(docs, told=merkle_manifest.tampered_leaf(divisor=7))
