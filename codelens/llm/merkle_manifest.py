"""Merkle manifest of a table: checkpoint-and-recompute.

Every row is a leaf, the SHA-256 of its columns; the leaves of a group, in key
order, form a binary hash tree, and the groups' roots, in group order, form
another one on top.  Only every ``STRIDE``-th level is written (Parquet, in the
shared checkpoint folder): one row per aligned subtree with the digests of its
stored descendants.  A proof is put together from the top down: each aligned
subtree regenerates its missing interior nodes from what is stored, emits the
siblings of every descendant in front of the siblings that its own top has
further up, and forgets the nodes again.  No task ever holds more of a tree
than subtrees of ``2^STRIDE`` nodes, however large a group is.

A proof is text, one mark per level from the leaf to the root: ``L<hex>`` (sibling
to the left), ``R<hex>`` (to the right) or ``H`` (a lone last node, hashed by itself).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelens.llm.store import few
from codelens.session import ensure_checkpoint_dir

#: Levels between two that are written.
STRIDE = 6
SPAN = 1 << STRIDE
#: Subtrees that a task takes apart at a time.
SLICE = 64
#: Groups up to which their table of counts is broadcast.
FEW_GROUPS = 50_000

MARK = re.compile("H|[LR][0-9a-f]{64}")


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts' concatenation."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(leaf: str, proof: str) -> str:
    """The root that ``leaf`` leads to by ``proof``."""
    node = leaf
    for m in MARK.findall(proof):
        node = digest(node) if m == "H" else digest(m[1:], node) if m[0] == "L" else digest(node, m[1:])
    return node


def siblings_digest(proof: str) -> str:
    """SHA-256 of the proof's siblings, concatenated from the leaf to the root."""
    return digest(re.sub("[HLR]", "", proof))


def interior(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of an aligned subtree, from ``nodes`` up to its top."""
    levels = [nodes]
    for _ in range(height):
        low = levels[-1]
        levels.append([digest(*low[i:i + 2]) for i in range(0, len(low), 2)])
    return levels


def paths(levels: list[list[str]]) -> list[str]:
    """The marks of every lowest node up to the top of its subtree, made from the
    top down, each interior node's once."""
    above = [""]
    for low in reversed(levels[:-1]):
        above = [("R" + low[i + 1] if i + 1 < len(low) else "H") + above[i >> 1] if i % 2 == 0 else "L" + low[i - 1] + above[i >> 1]
                 for i in range(len(low))]
    return above


def height_of(nodes: int, remaining: int) -> int:
    """Levels from ``nodes`` stored descendants to the top of their subtree, when
    the whole tree has ``remaining`` nodes on that level."""
    return STRIDE if remaining > SPAN else max(nodes - 1, 0).bit_length()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 over the columns: ``-`` for null, else UTF-8 byte count, colon, value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told), 256)


def _first_and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its rows, number of groups, first and last group (by digest) and the rows of the last."""
    pid, first, last, total, groups, tail = None, None, None, 0, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        pid = b.column("pid")[0].as_py()
        g, n = b.column("mark").to_pylist(), b.column("n").to_numpy()
        new = np.flatnonzero([x != y for x, y in zip(g, [last] + g[:-1])])
        first = g[0] if first is None else first
        groups += len(new)
        total += int(n.sum())
        tail = int(n[new[-1]:].sum()) if len(new) else tail + int(n.sum())
        last = g[-1]
    if pid is not None:
        yield pa.RecordBatch.from_pydict({"pid": [pid], "first": [first], "last": [last], "total": [total], "groups": [groups], "tail": [tail]},
                                         schema=pa.schema([("pid", pa.int32()), ("first", pa.string()), ("last", pa.string()),
                                                           ("total", pa.int64()), ("groups", pa.int64()), ("tail", pa.int64())]))


def _numbered(begin: dict[int, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the number of the group and the first position of each (counted) row in it.
    begin: per partition the number and the position that its first row has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = at = last = None
        for b in batches:
            if not b.num_rows:
                continue
            g, n = b.column("mark").to_pylist(), b.column("n").to_numpy()
            if gid is None:
                (gid, at), last = begin[b.column("pid")[0].as_py()], g[0]
            new = np.array([x != y for x, y in zip(g, [last] + g[:-1])])
            before = np.concatenate(([0], np.cumsum(n)))
            step = np.cumsum(new)
            # where the row's own group begins within the batch, or what it had before
            start = np.concatenate(([at], -before[:-1][new]))[step]
            gids = gid + step
            yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(start + before[:-1], pa.int64()), *b.columns],
                                             ["gid", "pos", *b.schema.names])
            gid, at, last = int(gids[-1]), int(start[-1] + before[-1]), g[-1]
    return run


def positions(rows: DataFrame) -> DataFrame:
    """(gid, pos, key, leaf, told) of rows (grp, key, leaf, told): the place of the
    group among the groups (null first, then by UTF-8 bytes) and that of the row in
    it by (key, leaf), both from 0.

    Equal rows are counted before the shuffle and get consecutive positions; a
    group lies in as many ranges of the sort as it needs.  What passes the
    driver is one line per partition.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.groupBy("grp", "key", "leaf", "told").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    ranged = (counted.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .select(F.sha2(F.coalesce(F.concat(F.lit(":"), F.col("grp").cast("string")), F.lit("-")), 256).alias("mark"), "key", "leaf", "told", "n",
                      F.spark_partition_id().alias("pid")).checkpoint(eager=True))  # fixed before it is read twice
    parts = sorted(ranged.mapInArrow(_first_and_last, "pid int, first string, last string, total long, groups long, tail long").collect(),
                   key=lambda r: r["pid"])
    begin, gid, at, last = {}, -1, 0, None
    for p in parts:
        if p["first"] != last:
            gid, at = gid + 1, 0
        begin[p["pid"]] = (gid, at)
        gid, at, last = gid + p["groups"] - 1, p["tail"] + (at if p["groups"] == 1 else 0), p["last"]
    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema.fields}
    numbered = ranged.mapInArrow(_numbered(begin), "gid long, pos long, " + ", ".join(f"{c} {kinds[c]}" for c in ranged.columns))
    # copies come out in two steps, so that a huge number of them never makes one huge array
    span = F.lit(65536).cast("long")
    wide = numbered.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / span))))
    wide = wide.withColumn("copy", F.explode(F.sequence(F.col("part") * span, F.least(F.col("n"), (F.col("part") + 1) * span) - 1)))
    return wide.select("gid", (F.col("pos") + F.col("copy")).alias("pos"), "key", "leaf", "told")


@dataclass
class Manifest:
    """The stored levels of a table's trees.

    folder: where they are; groups: (gid, n) as a table; stages: levels that are
    written for the groups' trees, top_stages: for the tree over the groups.
    """
    spark: SparkSession
    folder: str
    stages: int
    top_stages: int

    def level(self, tree: str, stage: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{tree}/{stage * STRIDE}")

    def proofs(self) -> DataFrame:
        """(key, leaf, told, subroot, root, proof) of every row."""
        above = None
        for tree, stages in (("top", self.top_stages), ("groups", self.stages)):
            if above is not None:  # what the group's root has above it goes on in the group's own tree
                above = above.select(F.col("pos").alias("gid"), F.lit(0).cast("long").alias("pos"), "proof", "root",
                                     F.col("node").alias("subroot"))
            for stage in reversed(range(stages)):
                above = self._down(self.level(tree, stage), above, tree == "groups" and stage == 0)
        return above

    def _down(self, blocks: DataFrame, above: DataFrame | None, leaves: bool) -> DataFrame:
        """The proofs of a level's nodes from those of the next written level."""
        if above is None:
            blocks = blocks.withColumns({"proof": F.lit(""), "root": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string")})
        else:
            up = above.select(F.col("gid").alias("g"), F.col("pos").alias("p"), "proof", "root", "subroot")
            # a tree that ends with this level has its only node at position 0 of the next one
            blocks = blocks.join(up, (F.col("gid") == F.col("g")) & (F.col("block") == F.col("p")))
        kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["nodes"].dataType.elementType.fields}
        kept = [c for c in kinds if c not in ("pos", "node")] if leaves else []
        names = ["gid", "pos", "node", "proof", "root", "subroot", *kept]
        schema = "gid long, pos long, node string, proof string, root string, subroot string" + "".join(f", {c} {kinds[c]}" for c in kept)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    nodes = part.column("nodes")
                    flat = nodes.flatten()
                    counts = nodes.value_lengths().to_pylist()
                    digests = flat.field("node").to_pylist()
                    proofs, roots, at = [], [], 0
                    for c, left, proof, root in zip(counts, *(part.column(x).to_pylist() for x in ("remaining", "proof", "root"))):
                        levels = interior(digests[at:at + c], height_of(c, left))
                        proofs += [x + proof for x in paths(levels)]
                        roots += [root or levels[-1][0]] * c
                        at += c
                    owner = pa.array(np.repeat(np.arange(part.num_rows), counts))
                    columns = [part.column("gid").take(owner), flat.field("pos"), flat.field("node"), pa.array(proofs, pa.string()),
                               pa.array(roots, pa.string()), part.column("subroot").take(owner), *(flat.field(c) for c in kept)]
                    yield pa.RecordBatch.from_arrays(columns, names)

        return blocks.select("gid", "remaining", "nodes", "proof", "root", "subroot").mapInArrow(run, schema)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, block, remaining, nodes) -> the node above each aligned subtree."""
    for batch in batches:
        gid, block, left, nodes = (batch.column(c) for c in ("gid", "block", "remaining", "nodes"))
        counts, digests, at, out = nodes.value_lengths().to_pylist(), nodes.flatten().field("node").to_pylist(), 0, []
        for c, n in zip(counts, left.to_pylist()):
            out.append(interior(digests[at:at + c], height_of(c, n))[-1][0])
            at += c
        yield pa.RecordBatch.from_arrays([gid, block, left, pa.array(out, pa.string())], ["gid", "pos", "remaining", "node"])


def _write_tree(nodes: DataFrame, most: int, path: str) -> tuple[DataFrame, int]:
    """Write the stored levels of trees of at most ``most`` nodes; (gid, node) of
    their roots and the number of written levels.  nodes: (gid, pos, remaining, node, ...)."""
    spark = nodes.sparkSession
    stage = 0
    while True:
        kept = [c for c in nodes.columns if c not in ("gid", "remaining")]
        blocks = (nodes.withColumn("block", F.floor(F.col("pos") / SPAN).cast("long"))
                  .groupBy("gid", "block").agg(F.max("remaining").alias("remaining"), F.sort_array(F.collect_list(F.struct(*kept))).alias("nodes")))
        blocks.write.parquet(f"{path}/{stage * STRIDE}")  # at most SPAN nodes a row
        tops = spark.read.parquet(f"{path}/{stage * STRIDE}").mapInArrow(_tops, "gid long, pos long, remaining long, node string")
        stage += 1
        if most <= SPAN:
            return tops.select("gid", "node"), stage
        most = -(-most // SPAN)
        # a tree that is complete passes its root on as its only node, up to the last level that is written
        nodes = tops.select("gid", "pos", F.ceil(F.col("remaining") / SPAN).cast("long").alias("remaining"), "node")


def build(docs: DataFrame, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
          told: Column | None = None) -> Manifest | None:
    """Write the manifest of ``docs``; None for an empty table.

    ``told`` is a leaf that is claimed for a row in place of its own (default: its
    own).  Nulls count as ``-``, also as a group (the first one) or a key (the first
    of its group); equal rows are leaves of their own, rows with an equal key stand in
    the order of their leaves; columns that are not named are not read.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().rstrip("/") + f"/manifest-{uuid.uuid4().hex}"
    leaf = leaf_digest([F.col(c) for c in columns])
    rows = docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf.alias("leaf"), (leaf if told is None else told).alias("told"))
    placed = positions(rows).checkpoint(eager=True)
    groups = placed.groupBy("gid").agg(F.count(F.lit(1)).alias("remaining")).checkpoint(eager=True)
    most, n_groups = groups.agg(F.max("remaining"), F.count(F.lit(1))).first()
    if not n_groups:
        return None
    sizes = F.broadcast(groups) if few(groups, FEW_GROUPS) else groups
    subroots, stages = _write_tree(placed.join(sizes, "gid").select("gid", "pos", "remaining", F.col("leaf").alias("node"), "key", "told"),
                                   most, f"{folder}/groups")
    top = subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.lit(n_groups).cast("long").alias("remaining"), "node")
    _root, top_stages = _write_tree(top, n_groups, f"{folder}/top")
    return Manifest(spark, folder, stages, top_stages)


def verify(proofs: DataFrame) -> DataFrame:
    """Adds ``proof_sha256`` (digest of the siblings), ``folded_root`` (from the told
    leaf by the proof) and ``verified`` to rows of ``proofs()``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof, told = batch.column("proof").to_pylist(), batch.column("told").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([siblings_digest(p) for p in proof], pa.string()),
                                              pa.array([fold(t, p) for t, p in zip(told, proof)], pa.string())],
                                             [*batch.schema.names, "proof_sha256", "folded_root"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in proofs.schema.fields)
    checked = proofs.mapInArrow(run, kinds + ", proof_sha256 string, folded_root string")
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(key: str = "doc_id", count: str = "n_chars", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                  divisor: int = 7) -> Column:
    """The leaf of a row whose ``count`` is one higher, where ``divisor`` divides the
    CRC-32 of its key as text (a null key: never; a null count stays)."""
    wrong = [F.col(c).cast("decimal(38,0)") + F.lit(1) if c == count else F.col(c) for c in columns]
    hit = F.coalesce(F.crc32(F.col(key).cast("string")) % divisor == 0, F.lit(False))
    return F.when(hit, leaf_digest(wrong)).otherwise(leaf_digest([F.col(c) for c in columns]))


def audit(docs: DataFrame, told: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row:
    its proof, folded from the leaf that ``told`` claims.  An empty table gives no row."""
    manifest = build(docs, told=told)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if manifest is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                                     "folded_root string, verified boolean")
    return verify(manifest.proofs()).select(F.col("key").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "proof_sha256",
                                            "folded_root", "verified")
