"""Near-duplicate groups by an n-gram Jaccard join with several global orders.

A document's set are its distinct five-word shingles.  Two sets with a Jaccard
similarity of at least 3/4 share a token among their first ``n - ceil(3n/4) + 1``
tokens (the prefix) under *every* order of all tokens.  Here three orders are
used: all put rare tokens first (by how often a token occurs in the corpus), each
breaks ties by a hash of its own.  Documents are candidates for each other only if
they share prefix tokens under all three:

1. ``TextStore`` and ``shared_keys`` (see ``winnow``) tell every chunk how frequent
   its tokens are.  A document whose prefix holds only tokens of its own is done.
2. Per order, documents that share a prefix token are connected, with the smallest
   document of a token as its centre, so a token of n documents gives n - 1
   edges and no pairs.  Documents can only be similar if they are connected under
   all orders: those triples of components are the candidate groups.
3. Each group is joined exactly.  Documents gather in stars around a centre whose
   distance to every member is known; a newcomer is compared with the centres,
   and with a member only if the triangle inequality of the Jaccard distance
   allows a link, the prefixes share tokens under all orders, and the two are not
   connected yet.  A group too large for one task is cut into blocks, and every
   pair of blocks is joined that way.
4. Connected components of the links.

No bucket or group is capped; equal texts are one document until the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm import textops as T
from codelens.llm.store import fresh, materialize
from codelens.llm.winnow import (NO_ID, Chunk, TextStore, below_bucket, key_buckets, key_levels, pack32, shared_keys, split_keys,
                                 unpack32)

SHINGLE = 5
SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
ORDERS = len(SEEDS)
FREQUENCY = (2, 17, 1025)
BLOCK = 4000
PIECE = 1 << 18


def normalise(text: bytes) -> bytes:
    """ASCII letters lower-cased, words joined by one space."""
    return b" ".join(text.lower().split())


def shingle_sets(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): each text's distinct shingles in ascending order; a text of
    one to four words is one shingle, a text without words has none."""
    parts, sizes = [], []
    for _first, data, offsets in chunk.pieces(PIECE):
        a, b = T.words_of(data, offsets)
        words = T.span_ids(data, a, b)
        at = T.counts_to_offsets(T.rows_of(a, offsets), len(offsets) - 1)
        grams = T.fold_hash(words, SHINGLE)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            n = hi - lo
            s = np.unique(grams[lo:hi - SHINGLE + 1]) if n >= SHINGLE else T.mix64(T.fold_hash(words[lo:hi], n) + np.uint64(n)) if n else words[:0]
            parts.append(s)
            sizes.append(len(s))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def prefix_length(n: int) -> int:
    """Tokens of which one at least is shared with every set at similarity 3/4."""
    return n - (3 * n + 3) // 4 + 1


def prefixes(keys: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The prefix under each order, without tokens that no other document has."""
    n = prefix_length(len(keys))
    out = []
    for seed in SEEDS:
        first = np.lexsort((T.mix64(keys ^ np.uint64(seed)), level))[:n]
        out.append(keys[first[level[first] > 0]])
    return out


def _levels(chunk: Chunk, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, offsets, frequency level of each key)."""
    got = {b: x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist()) if b >= 0}
    keys, at = shingle_sets(chunk)
    u, inverse, _n = T.distinct(keys)
    return keys, at, key_levels(u, got, buckets)[inverse]


def _possible(at: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Texts with a shared token in their prefix (it is the same test under every
    order: fewer tokens of their own than the prefix is long)."""
    n = np.diff(at)
    own = n - T.sums_by_row(level > 0, at)
    return np.flatnonzero((n > 0) & (own < n - (3 * n + 3) // 4 + 1))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): the smallest node of each component, by
    label propagation with pointer jumping.  Every round is cut off by a checkpoint."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("root").alias("r"))
        seen = both.join(theirs, "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        nearer = labels.join(seen, "node").select("node", "root", F.least("root", "r").alias("r"))
        # the root of a node learns what its members have seen, then every node takes its root's label
        hooked = (nearer.select(F.col("root").alias("node"), "r").unionByName(nearer.select("node", "r"))
                  .groupBy("node").agg(F.min("r").alias("r")))
        after = (labels.join(hooked, "node").select("node", "root", "r")
                 .join(hooked.select(F.col("node").alias("r"), F.col("r").alias("rr")), "r", "left")
                 .select("node", F.col("root").alias("old"), F.least("r", "rr").alias("root")))
        after = materialize(after)
        changed = after.where(F.col("old") != F.col("root")).limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


class _Stars:
    """Exact join of documents into components (see step 3)."""

    def __init__(self):
        self.sets: list[set] = []
        self.prefix: list[list[set]] = []
        self.stars: list[tuple[int, list[int], list[float]]] = []     # centre, members, distances
        self.parent: list[int] = []
        self.by_token: dict[int, set[int]] = {}

    def _find(self, s: int) -> int:
        while self.parent[s] != s:
            self.parent[s] = self.parent[self.parent[s]]
            s = self.parent[s]
        return s

    def _distance(self, x: int, y: int) -> tuple[float, bool]:
        common = len(self.sets[x] & self.sets[y])
        union = self.size[x] + self.size[y] - common
        return 1.0 - common / union, 4 * common >= 3 * union

    def join(self, sizes: list[int], sets: list[set], prefix: list[list[set]]) -> list[int]:
        """Root document of every document; ``sets`` hold the tokens that others have too."""
        self.size, self.sets, self.prefix = sizes, sets, prefix
        home = []
        for x in range(len(sets)):
            near: dict[int, int] = {}
            for t in prefix[x][0]:
                for s in self.by_token.get(t, ()):
                    near[s] = near.get(s, 0) + 1
            mine = None
            linked: list[int] = []
            for s in sorted(near, key=lambda s: (-near[s], s)):
                if any(self._find(s) == self._find(o) for o in linked):
                    continue
                centre, members, distances = self.stars[s]
                d, link = self._distance(x, centre)
                if link:
                    if mine is None:
                        mine = s
                        members.append(x)
                        distances.append(d)
                else:
                    # members whose distance from the centre leaves room for a link
                    for i in np.flatnonzero(np.abs(np.array(distances) - d) <= 0.25 + 1e-9).tolist():
                        y = members[i]
                        if all(not p.isdisjoint(q) for p, q in zip(prefix[x], prefix[y])) and self._distance(x, y)[1]:
                            link = True
                            break
                if link:
                    linked.append(s)
            if mine is None:
                mine = len(self.stars)
                self.stars.append((x, [x], [0.0]))
                self.parent.append(mine)
            for s in linked:
                self.parent[self._find(s)] = self._find(mine)
            for t in prefix[x][0]:
                self.by_token.setdefault(t, set()).add(mine)
            home.append(mine)
        least: dict[int, int] = {}
        for x, s in enumerate(home):
            least.setdefault(self._find(s), x)
        return [least[self._find(s)] for s in home]


def _links(table: pa.Table) -> tuple[list[int], list[int]]:
    """Edges (document, root) among the documents of a task, group by group."""
    task_group, node, size, body = (table.column(c).to_pylist() for c in ("grp", "node", "n", "body"))
    groups: dict[int, list[int]] = {}
    for i in sorted(range(len(node)), key=node.__getitem__):
        groups.setdefault(task_group[i], []).append(i)
    a, b = [], []
    for rows in groups.values():
        sets, pre, own = [], [], []
        for i in rows:
            keys = np.frombuffer(body[i], np.uint64, size[i])
            level = np.frombuffer(body[i], np.uint8, size[i], 8 * size[i])
            sets.append(set(keys[level > 0].tolist()))
            pre.append([set(p.tolist()) for p in prefixes(keys, level)])
            own.append(1 - len(sets[-1]) / size[i])
        # originals before their edited copies: a text with few tokens of its own is the better centre
        best = sorted(range(len(rows)), key=lambda x: (own[x], rows[x]))
        rows, sets, pre = ([v[x] for x in best] for v in (rows, sets, pre))
        for i, root in zip(rows, _Stars().join([size[i] for i in rows], sets, pre)):
            if rows[root] != i:
                a.append(node[rows[root]])
                b.append(node[i])
    return a, b


def grouped_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, h1, h2 (hashes of its text), n (shingles) and
    root (a number of its group; null without shingles)."""
    store = TextStore.build(docs)
    buckets = key_buckets(store.chunks)

    def keys_of(chunk: Chunk) -> tuple[np.ndarray, bytes]:
        keys, at = shingle_sets(chunk)
        return keys, b"".join(x.astype(np.int64).tobytes() for x in (chunk.h1, chunk.h2, np.diff(at)))

    masks = materialize(shared_keys(store, keys_of, normalise, buckets, FREQUENCY))

    def read_note(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist()):
                h1, h2, n = np.frombuffer(blob, np.int64).reshape(3, -1)
                node = (np.int64(chunk) << np.int64(32)) + np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, h1, h2, n)], ["node", "h1", "h2", "n"])

    texts = masks.where("bucket < 0").mapInArrow(read_note, "node long, h1 long, h2 long, n long")

    def tokens(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, at, level = _levels(Chunk.load(table, normalise), answers, buckets)
        rows = []
        found: list[list] = [[] for _ in SEEDS]
        owner: list[int] = []
        for r in _possible(at, level).tolist():
            for o, p in enumerate(prefixes(keys[at[r]:at[r + 1]], level[at[r]:at[r + 1]])):
                found[o].append((p, r))
        for o, parts in enumerate(found):
            if not parts:
                continue
            k = np.concatenate([p for p, _r in parts])
            owner = np.repeat(np.array([r for _p, r in parts], dtype=np.uint32), [len(p) for p, _r in parts])
            order = np.argsort(k, kind="stable")
            k, owner = k[order], owner[order]
            cut, low = split_keys(k, buckets), below_bucket(k, buckets)
            for b in np.flatnonzero(np.diff(cut)).tolist():
                rows.append((key[0].as_py(), o * buckets + b, pack32(low[cut[b]:cut[b + 1]]), owner[cut[b]:cut[b + 1]].tobytes()))
        c, b, k, w = zip(*rows) if rows else ((),) * 4
        return pa.table({"chunk": pa.array(c, pa.int32()), "bucket": pa.array(b, pa.int32()), "keys": pa.array(k, pa.binary()),
                         "owners": pa.array(w, pa.binary())})

    def connect(key: tuple, table: pa.Table) -> pa.Table:
        k = np.concatenate([unpack32(x) for x in table.column("keys").to_pylist()])
        node = np.concatenate([(np.int64(c) << np.int64(32)) + np.frombuffer(w, np.uint32).astype(np.int64)
                               for c, w in zip(table.column("chunk").to_pylist(), table.column("owners").to_pylist())])
        order = np.lexsort((node, k))
        k, node = k[order], node[order]
        press = zstandard.ZstdCompressor(level=1)
        first = np.concatenate(([True], k[1:] != k[:-1]))
        centre = node[np.flatnonzero(first)][np.cumsum(first) - 1]
        pair = np.unique(np.stack((node, centre), axis=1)[centre != node], axis=0)
        home = pair[:, 0] >> 32
        cut = np.flatnonzero(np.concatenate((home[1:] != home[:-1], [True]))) + 1 if len(home) else np.zeros(0, np.int64)
        parts = [pair[i:j] for i, j in zip([0, *cut[:-1]], cut)]
        return pa.table({"chunk": pa.array([int(x[0, 0]) >> 32 for x in parts], pa.int32()),
                         "rank": pa.array([key[0].as_py() // buckets] * len(parts), pa.int32()),
                         "blob": pa.array([press.compress(x.tobytes()) for x in parts], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """The distinct edges of a chunk's documents, over all buckets."""
        unpack = zstandard.ZstdDecompressor()
        parts = [np.frombuffer(unpack.decompress(x), np.int64).reshape(-1, 2) + (np.int64(o) << np.int64(60))
                 for o, x in zip(table.column("rank").to_pylist(), table.column("blob").to_pylist())]
        pair = np.unique(np.concatenate(parts), axis=0)
        return pa.table({"a": pa.array(pair[:, 1]), "b": pa.array(pair[:, 0])})

    chunks = store.table.groupBy("chunk")
    sent = chunks.cogroup(masks.groupBy("chunk")).applyInArrow(tokens, "chunk int, bucket int, keys binary, owners binary")
    edges = (sent.groupBy("bucket").applyInArrow(connect, "chunk int, rank int, blob binary")
             .groupBy("chunk").applyInArrow(gather, "a long, b long"))
    roots = connected_components(edges)
    plain = F.col("node").bitwiseAND(F.lit((1 << 60) - 1))
    order = F.shiftright("node", 60)
    per_node = (roots.groupBy(plain.alias("node"))
                .agg(*[F.max(F.when(order == o, F.col("root"))).alias(f"c{o}") for o in range(ORDERS)])
                .where(" and ".join(f"c{o} is not null" for o in range(ORDERS)))
                .select("node", F.xxhash64(*[f"c{o}" for o in range(ORDERS)]).alias("grp")))
    per_node = materialize(per_node)
    sizes = per_node.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = per_node.join(sizes, "grp")
    count = F.ceil(F.col("members") / block).cast("int")
    mine = F.expr("int(pmod(xxhash64(node), blocks))")
    # a group of several blocks: one task per pair of blocks; a document goes to all pairs with its block
    placed = placed.withColumn("blocks", count).withColumn("mine", mine)
    tasks = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", F.shiftright("node", 32).cast("int").alias("chunk"),
                     F.when(F.col("blocks") == 1, F.col("grp"))
                     .otherwise(F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other"))).alias("grp"),
                     (F.col("blocks") > 1).alias("shared")))
    tasks = materialize(tasks)
    n_tasks = max(8, -(-tasks.count() // block))

    def deliver(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        kind = side.column("kind").to_numpy()
        answers = side.filter(pa.array(kind == 0))
        wanted = side.filter(pa.array(kind == 1))
        if not wanted.num_rows:
            rows: list[tuple] = []
        else:
            keys, at, level = _levels(Chunk.load(table, normalise), answers, buckets)
            rows = [(grp % n_tasks, grp, node, int(at[(node & 0xFFFFFFFF) + 1] - at[node & 0xFFFFFFFF]),
                     keys[at[node & 0xFFFFFFFF]:at[(node & 0xFFFFFFFF) + 1]].tobytes()
                     + level[at[node & 0xFFFFFFFF]:at[(node & 0xFFFFFFFF) + 1]].tobytes())
                    for node, grp in zip(wanted.column("node").to_pylist(), wanted.column("grp").to_pylist())]
        t, g, v, n, body = zip(*rows) if rows else ((),) * 5
        return pa.table({"task": pa.array(t, pa.int32()), "grp": pa.array(g, pa.int64()), "node": pa.array(v, pa.int64()),
                         "n": pa.array(n, pa.int32()), "body": pa.array(body, pa.binary())})

    def link(table: pa.Table) -> pa.Table:
        a, b = _links(table)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    side = (masks.select("chunk", F.lit(0).alias("kind"), "bucket", "blob", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("grp"))
            .unionByName(tasks.select("chunk", F.lit(1).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "node", "grp")))
    delivered = chunks.cogroup(side.groupBy("chunk")).applyInArrow(deliver, "task int, grp long, node long, n int, body binary")
    links = delivered.groupBy("task").applyInArrow(link, "a long, b long")
    if tasks.where("shared").limit(1).count():
        groups = connected_components(links)
    else:  # every group was joined in one task: the links lead straight to the roots
        groups = links.select(F.col("b").alias("node"), F.col("a").alias("root"))

    member = texts.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return store.rows.select("doc_id", "h1", "h2").join(member.where("n > 0").select("h1", "h2", "n", "root"), ["h1", "h2"], "left")


def near_duplicate_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id of its group).

    Null and empty texts, and texts without words, have no shingles and are linked
    with nothing, not even their copies: their component is their own id.  Rows
    with a null doc_id take part; a group of only such rows has a null component.
    Repeated rows share a component.  Extra columns are not read.
    """
    rows = materialize(grouped_texts(docs, block))
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (rows.join(least, "root", "left")
            .select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
                    F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each group, the one with the smallest id (null last, then by
    text hash); columns unchanged.  Documents without shingles all stay; of
    identical rows one stays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("h1"),
                   F.xxhash64(F.lit(7), text).alias("h2"))
    name = fresh(docs, "_key")
    rows = (materialize(grouped_texts(docs.select("doc_id", "text"), block)).where(F.col("root").isNotNull())
            .select("root", F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "h1", "h2").alias(name)))
    judged = rows.join(rows.groupBy("root").agg(F.min(name).alias("first")), "root")
    gone = judged.where(F.col(name) != F.col("first")).select(name).distinct()
    kept = docs.withColumn(name, key).join(gone, name, "left_anti")
    twice = materialize(judged.where(F.col(name) == F.col("first")).groupBy(name).count().where("count > 1").select(name))
    if twice.limit(1).count():
        kept = (kept.join(twice, name, "left_anti")
                .unionByName(kept.join(twice, name, "left_semi").dropDuplicates([name])))
    return kept.select(*docs.columns)
