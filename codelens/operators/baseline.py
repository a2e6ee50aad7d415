"""Feature -> browser-baseline lookups (JOIN-01..04).

Every lookup is a left equi-join of the (large) ``features`` table with a
small, bounded dimension, so it compiles to a BroadcastHashJoin: no shuffle of
the fact table, and a hot ``scan_id`` or ``feature`` cannot skew it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelens.dims import bounded_broadcast
from codelens.functions.status import worst_of
from codelens.rules import BROWSERS

UNMAPPED_NOTE = "No baseline mapping available (fallback)"


#: Length of the substrings by which names are found.
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def first_containing(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(key, ord): for every key the smallest ``ord`` of a row of ``names`` (ord, texts)
    one of whose texts contains it; keys that none contains are left out.

    Equi-joins on substrings only.  A key of up to three characters is itself a substring
    of a text, so the first row that has it is its answer (for an empty key the first row of all).
    A longer key is looked up by its substring of three that the fewest texts have, and the rows
    found are compared as a whole.

    Spark's estimates know nothing of exploded rows (a catalogue file of 5 MB has
    50 million substrings), so whatever grows with ``names`` is hinted to a sort-merge
    join: none of it is broadcast, which the driver would have to hold.
    """
    texts = names.select("ord", F.explode("texts").alias("text"))
    upto = texts.select("ord", F.explode(F.concat(F.array(F.lit("")), *[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])).alias("key"))
    short = keys.where(F.length("key") <= GRAM).join(upto.groupBy("key").agg(F.min("ord").alias("ord")).hint("merge"), "key").select("key", "ord")
    found = texts.select("ord", F.explode(F.array_distinct(_grams(F.col("text"), GRAM))).alias("gram"))
    times = found.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    parts = keys.where(F.length("key") > GRAM).select("key", F.explode(F.array_distinct(_grams(F.col("key"), GRAM))).alias("gram"))
    # a key with a substring that no text has is contained in none
    rarest = (parts.join(times.hint("merge"), "gram", "left").groupBy("key")
              .agg(F.min_by("gram", F.struct("times", "gram")).alias("gram"), F.count("times").alias("known"), F.count(F.lit(1)).alias("all"))
              .where(F.col("known") == F.col("all")).select("key", "gram"))
    rows = found.hint("merge").join(rarest, "gram").select("key", "ord").distinct()
    whole = rows.join(texts.hint("merge"), "ord").where(F.col("text").contains(F.col("key"))).groupBy("key").agg(F.min("ord").alias("ord"))
    return short.unionByName(whole)


def _unknown_support():
    return F.create_map(*[x for b in BROWSERS for x in (F.lit(b), F.lit("unknown"))])


def support_map(key: str, value: F.Column) -> F.Column:
    """MAP<key, value> aggregate; of repeated keys the greatest value stays (a
    map cannot hold both)."""
    entries = F.array_sort(F.collect_set(F.struct(F.col(key).alias("k"), value.alias("v"))))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (F.get(entries, i + 1)["k"] != e["k"]))
    return F.map_from_entries(F.filter(last, lambda e: e["k"].isNotNull()))


def dim_by_feature(feature_dim: DataFrame) -> DataFrame:
    """One row per feature: ``support`` MAP over the four browsers (missing ->
    unknown) and the worst-case ``status`` (JOIN-04)."""
    d = feature_dim.filter(F.col("browser").isin(*BROWSERS))
    agg = d.groupBy("feature").agg(
        support_map("browser", F.coalesce("support", F.lit("unknown"))).alias("_m"),
        F.max(F.coalesce("notes", F.lit(""))).alias("dim_notes"))
    support = F.create_map(*[x for b in BROWSERS
                             for x in (F.lit(b), F.coalesce(F.col("_m")[b], F.lit("unknown")))])
    return agg.select("feature", support.alias("support"), "dim_notes").withColumn(
        "status", worst_of(F.map_values("support")))


def lookup_baseline(features: DataFrame, feature_dim: DataFrame) -> DataFrame:
    """JOIN-01: ``features(scan_id, file, feature)`` -> ``baseline`` rows
    ``(scan_id, file, feature, status, support, notes)``.

    Unmapped features get status ``unknown`` on every browser.
    """
    dim = bounded_broadcast(dim_by_feature(feature_dim))
    f = features.withColumn("feature", F.trim(F.col("feature")))
    j = f.join(dim, "feature", "left")
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    return j.select(
        *[c for c in features.columns],
        status.alias("status"),
        F.coalesce(F.col("support"), _unknown_support()).alias("support"),
        F.when(status == "unknown", F.lit(UNMAPPED_NOTE)).otherwise(F.coalesce("dim_notes", F.lit(""))).alias("notes"),
    )


def classify_compat_entry(entries) -> F.Column:
    """Status of one browser's compat record (an array of support entries;
    the last one is used): missing/false/null version -> unsupported;
    partial flag, flags, prefix or alternative name -> partial; else supported."""
    pick = F.element_at(entries, -1)
    va = pick["version_added"]
    return (F.when(entries.isNull() | (F.size(entries) == 0), "unknown")
            .when(va.isNull() | (F.lower(va) == "false"), "unsupported")
            .when(F.coalesce(pick["partial_implementation"], F.lit(False)), "partial")
            .when(F.coalesce(pick["flags"], F.lit(False)) | pick["prefix"].isNotNull()
                  | pick["alternative_name"].isNotNull(), "partial")
            .otherwise("supported"))


def lookup_compat(baseline: DataFrame, aliases: DataFrame, compat: DataFrame) -> DataFrame:
    """JOIN-02: for rows still ``unknown``, feature -> alias path -> compat
    record ``(path, browser, entries)``; per-browser status and worst case.

    Two left joins against bounded dims (aliases is a fixed list; compat is
    keyed by path and filtered to the alias paths first)."""
    c = compat.join(F.broadcast(aliases.select("path").distinct()), "path", "left_semi")
    per_path = c.groupBy("path").agg(support_map("browser", classify_compat_entry(F.col("entries"))).alias("_cm"))
    support = F.create_map(*[x for b in BROWSERS
                             for x in (F.lit(b), F.coalesce(F.col("_cm")[b], F.lit("unknown")))])
    resolved = (bounded_broadcast(aliases).join(bounded_broadcast(per_path), "path", "inner")
                .select("feature", support.alias("_csupport")))
    j = baseline.join(F.broadcast(resolved), "feature", "left")
    use = (F.col("status") == "unknown") & F.col("_csupport").isNotNull()
    return j.select(
        *[c for c in baseline.columns if c not in ("status", "support", "notes")],
        F.when(use, worst_of(F.map_values("_csupport"))).otherwise(F.col("status")).alias("status"),
        F.when(use, F.col("_csupport")).otherwise(F.col("support")).alias("support"),
        F.when(use, F.lit("")).otherwise(F.col("notes")).alias("notes"),
    )


def lookup_web_features(baseline: DataFrame, web_features: DataFrame) -> DataFrame:
    """JOIN-03: for rows still ``unknown``, the first catalogue row (by
    ``ord``) whose lower name or slug contains the lower feature key.

    Free text among the keys (``core-js/...`` import paths) grows with the corpus and
    so may the catalogue: both meet through their substrings (``first_containing``),
    never pair by pair.  Rows that share an ``ord`` rank by slug, then name.
    """
    keys = baseline.filter(F.col("status") == "unknown").select("feature", F.lower("feature").alias("key")).distinct()
    name, slug = (F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "slug"))
    cat = web_features.select("ord", F.array(name, slug).alias("texts"), F.coalesce("slug", "name").alias("_label"), "support")
    hits = keys.join(first_containing(keys.select("key").distinct(), cat.select("ord", "texts")), "key")
    # of the rows with that ord, one that contains the key; the catalogue is not broadcast
    matches = hits.join(cat.hint("merge"), "ord").where(F.exists("texts", lambda t: t.contains(F.col("key"))))
    first = matches.groupBy("feature").agg(F.min_by(F.struct("support", "_label"), F.col("_label")).alias("_hit"))
    wsupport = F.create_map(*[x for b in BROWSERS
                              for x in (F.lit(b), F.coalesce(F.col("_hit.support")[b], F.lit("unknown")))])
    j = baseline.join(first, "feature", "left")
    use = (F.col("status") == "unknown") & F.col("_hit").isNotNull()
    return j.select(
        *[c for c in baseline.columns if c not in ("status", "support", "notes")],
        F.when(use, worst_of(F.map_values(wsupport))).otherwise(F.col("status")).alias("status"),
        F.when(use, wsupport).otherwise(F.col("support")).alias("support"),
        F.when(use, F.concat(F.lit("Fallback from web-features for '"), F.col("_hit._label"), F.lit("'")))
        .otherwise(F.col("notes")).alias("notes"),
    )
