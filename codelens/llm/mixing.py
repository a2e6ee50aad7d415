"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Targets: every source gets a share of ``total_share`` times all words, in
proportion to its weight, but at most ``max_copies`` times its own size; what a
capped source cannot take is shared out again by weight until no source is above
its cap.  The fixed point has a closed form: with sources sorted by
``cap / weight`` the capped ones are a prefix, and the others get
``level * weight``.

Selection: ``target / size`` says how often a source is repeated.  Its whole
part is allocated with certainty.  For the rest, documents are ranked by
``(u / (1-u)) / (p / (1-p))`` with a random ``u`` that depends on the document's
id only and its inclusion probability ``p`` (Rosen's Pareto order sampling), and
are taken from the lowest rank on until the source's remaining words are
reached.  The cut-off is found with a histogram over 4096 rank bins per source;
only the one bin that the cut falls into is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelens.llm.store import few, fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def cycling_weights(sizes: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Add ``weight`` to one row per source: ``cycle`` dealt out in order of
    code points, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = (F.row_number().over(order) - 1) % len(cycle)
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (pos + 1).cast("int")))


def source_targets(sizes: DataFrame, total_share: float, max_copies: int) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``.  One row per
    source, so the ordered windows see as many rows as there are sources."""
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    capped = sizes.withColumns({
        "cap": F.lit(float(max_copies)) * F.col("source_size"),
        "total": F.lit(float(total_share)) * F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
        "words_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = ((F.col("total") - F.lit(float(max_copies)) * F.col("words_before"))
             / (F.col("all_weight") - F.col("weight_before")))
    levelled = capped.withColumn("level", level)
    # the first source whose cap is not reached fixes the level of all after it
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                         F.struct((F.col("source_size") / F.col("weight")).alias("r"),
                                  F.col("source").isNull().alias("n"), F.col("source").alias("s"),
                                  F.col("level").alias("level")))).over(everything)
    return (levelled.withColumn("final", first["level"])
            .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")))
            .select("source", "source_size", "weight", "target"))


def random_unit(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def allocate_copies(rows: DataFrame, targets: DataFrame, max_copies: int, seed: str = "mix",
                    importance: str | None = None) -> DataFrame:
    """rows (doc_id, source, size, ...) -> the same with source_size, target and ``copies``.

    ``importance`` names a positive column that makes a document likelier within
    its source: ``p = 1 - (1 - rest) ** importance`` (all 1 by default).
    """
    joined = rows.withColumn("source_key", F.struct(F.col("source").isNull().alias("n"),
                                                    F.coalesce("source", F.lit("")).alias("s")))
    t = targets.select(F.struct(F.col("source").isNull().alias("n"),
                                F.coalesce("source", F.lit("")).alias("s")).alias("source_key"),
                       "source_size", "target")
    # one row per source: broadcast when they are few, so that no source has to meet in one task
    joined = joined.join(F.broadcast(t) if few(t, 100_000) else t, "source_key")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = joined.withColumn("whole", F.least(F.floor(ratio), F.lit(max_copies)).cast("long"))
    joined = joined.withColumn("rest_words", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    rest = ratio - F.col("whole")
    p = rest if importance is None else F.lit(1.0) - F.pow(F.lit(1.0) - rest, F.col(importance))
    u = random_unit(F.col("doc_id"), seed)
    # odds(u) / odds(p), folded into [0, 1): same order as the quotient itself
    a, b = u * (F.lit(1.0) - p), p * (F.lit(1.0) - u)
    ranked = joined.withColumn("u", u).withColumn("rank", F.when(a + b > 0, a / (a + b)).otherwise(F.lit(1.0)))
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))
    bins = ranked.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_words"),
                                                   F.first("rest_words").alias("rest_words"))
    before = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (bins.withColumn("words_before", F.coalesce(F.sum("bin_words").over(before), F.lit(0)))
            .withColumn("side", F.when(F.col("rest_words") <= 0, -1)  # whole copies are all: nothing to cut
                        .when(F.col("words_before") + F.col("bin_words") <= F.col("rest_words"), 1)
                        .when(F.col("words_before") <= F.col("rest_words"), 0).otherwise(-1))
            .select("source_key", "bin", "words_before", "side"))
    placed = ranked.join(bins, ["source_key", "bin"])
    drop = ["source_key", "whole", "rest_words", "u", "rank", "bin", "words_before", "side"]
    clear = placed.where(F.col("side") != 0).withColumn("copies", F.col("whole") + F.when(F.col("side") == 1, 1).otherwise(0))
    order = (Window.partitionBy("source_key").orderBy("rank", "u", "doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    cut = placed.where(F.col("side") == 0)
    so_far = F.col("words_before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = cut.withColumn("copies", F.col("whole") + F.when(so_far + F.col("size") / 2 <= F.col("rest_words"), 1).otherwise(0))
    return clear.drop(*drop).unionByName(cut.drop(*drop))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, max_copies: int = 2,
        seed: str = "mix", importance: str | None = None) -> DataFrame:
    """Copies to take of every document: (doc_id, source, size, source_size, target, copies[, importance]).

    Null sources form one source of their own, ordered last; null texts have
    size 0; documents without words and sources without words take nothing that
    counts; repeated rows are separate documents; an empty table gives an empty
    result.  The text is read once; everything later works on three slim columns.
    """
    extra = [importance] if importance else []
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *extra))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(cycling_weights(sizes, weights), total_share, max_copies)
    return allocate_copies(rows, materialize(targets), max_copies, seed, importance)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5,
                    max_copies: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as ``mix`` allocates it, columns
    unchanged.  The per-document decision is computed in place from a joined
    per-source cut (a rank threshold), so the texts are not shuffled."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = materialize(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(cycling_weights(sizes, weights), total_share, max_copies))
    copies = allocate_copies(rows, targets, max_copies, seed)
    # rank of the last taken document of each source: one row per source
    ranks = copies.withColumn("u", random_unit(F.col("doc_id"), seed))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")),
                                                     F.lit(max_copies))).otherwise(0).cast("long")
    cut = (ranks.withColumn("whole", whole).groupBy("source")
           .agg(F.max(F.when(F.col("copies") > F.col("whole"), F.struct("u", "doc_id", "size"))).alias("last"),
                F.first("whole").alias("whole")))
    name = fresh(docs, "_mix_")
    cut = cut.select(F.col("source").alias(name + "source"), F.col("last").alias(name + "last"), F.col("whole").alias(name + "whole"))
    mine = F.struct(random_unit(F.col("doc_id"), seed).alias("u"), F.col("doc_id"), word_count(F.col("text")).alias("size"))
    n = F.col(name + "whole") + F.when(mine <= F.col(name + "last"), 1).otherwise(0)
    out = docs.join(F.broadcast(cut) if few(cut, 100_000) else cut, F.col("source").eqNullSafe(F.col(name + "source")))
    out = out.withColumn(name + "copy", F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))))
    return out.select(*docs.columns)
