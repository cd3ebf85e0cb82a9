"""Operator 1: n-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct k-word shingles (A-Z lower-cased), as 64-bit hashes. The hashes
are dealt into D groups (D a power of two that follows the size of the set); the group counts are
the document's point. For two points the sum of the coordinate minima bounds the overlap of the
sets from above. Points are bulk-loaded into R-trees whose nodes keep their upper corner and
their range of sizes, and the self-join of a tree prunes pairs of nodes whose bound is below the
overlap that the threshold asks for. Surviving pairs are verified on the sets themselves. Every
link comes out of a tree.

Points of ordinary texts spread over all coordinates, so one tree over a whole corpus would
compare nearly all nodes. Which points share a tree is therefore decided first, without loss: of a
set of n hashes, ordered by rising frequency (a count sketch over all documents, by which only
speed depends) and hash, two linked sets share one of the first n - ceil(t n) + 1. Keys are counted
first, and only those held by several sets go on; each makes a bucket, one bucket of those with the
same members is kept, and its points make a tree.

Links are needed for components only, so groups of near copies are not expanded into all pairs.
Trees are joined in three rounds, each of which looks only for pairs in different components of the
links found before: within blocks of ``BLOCK`` points of a bucket, of each point only its nearest
pair; then among one point of each component in a bucket, again the nearest; and then all pairs
that are left, buckets over ``BUCKET`` points in blocks, each pair of blocks a tree of its own. A tree
that has more pairs than points there, as of many texts just below the threshold, is dealt again
with its sets, and verified by its task, which gives only links that join components.

Equal sets are one class from the start (copies are not compared). Defined results: null and
empty texts have the empty set and link with nothing; a text of fewer words than k has one
shingle, its whole sequence; rows with a null doc_id are reported with a null component and
link with nothing; rows that repeat a doc_id are one vertex with each of their sets; an empty
table gives no rows; further columns are ignored. Sets are named by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import Workspace, mix, parts_of, shingle_sets, small_batches, text_slices
from strandlog.llm.components import components

#: Counters of the frequency sketch (4 bytes each): a power of two between these, by the size of the input.
SKETCH, MOST_SKETCH = 1 << 18, 1 << 22
#: Sketches that one task adds up.
FAN = 16
#: Points of a tree in the first two rounds, and of a block in the last.
BLOCK = 512
BUCKET = 2048
#: Shingles (8 bytes each) of a tree whose pairs are verified where it is.
HELD = 4 << 20
LEAF = 48
#: Ids that are broadcast to pick rows at the scan; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set of hashes."""
    if not len(shingles):
        return 0
    place = mix(np.arange(1, len(shingles) + 1, dtype=np.uint64))
    return int(mix(np.array([(mix(shingles) * (place | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts of the set's hashes in D groups, as bytes. D is twice the size of a small set (up to 256), half that of a large one (up to 2048), or more, and grows until every count fits."""
    d, n = 16, len(shingles)
    while d < min(2 * n, max(256, n // 2), 2048):
        d *= 2
    while True:
        counts = np.bincount((shingles & np.uint64(d - 1)).astype(np.int64), minlength=d)
        if counts.max(initial=0) <= 255:
            return counts.astype(np.uint8)
        d *= 2


def fold(points: np.ndarray, d: int) -> np.ndarray:
    """Points of more groups in d groups: group g of d is the sum of the groups that are g modulo d."""
    return points.reshape(len(points), -1, d).sum(1, dtype=np.int32)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed coordinate minima of each row of a with each row of b."""
    return np.minimum(a[:, None, :], b[None, :, :]).sum(2)


class CountTree:
    """An R-tree over points, bulk-loaded by halving along the widest coordinate; nodes: upper corner, sizes, one component or none."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, group: np.ndarray):
        self.points, self.sizes, self.group = points, sizes, group
        self.nodes: list[tuple] = []
        self.root = self._load(np.arange(len(points))) if len(points) else -1

    def _load(self, rows: np.ndarray) -> int:
        stack, root = [(rows, None, 0)], None
        while stack:
            rows, parent, side = stack.pop()
            pts, sz, gr = self.points[rows], self.sizes[rows], self.group[rows]
            me = len(self.nodes)
            node = [pts.max(0), int(sz.min()), int(sz.max()), int(gr[0]) if (gr == gr[0]).all() else None, rows, None, None]
            self.nodes.append(node)
            if parent is None:
                root = me
            else:
                self.nodes[parent][5 + side] = me
            if len(rows) > LEAF:
                spread = pts.max(0) - pts.min(0)
                key = sz if sz.max() > 1.2 * max(1, sz.min()) else pts[:, int(spread.argmax())]
                order = np.argsort(key, kind="stable")
                half = len(rows) // 2
                stack += [(rows[order[half:]], me, 1), (rows[order[:half]], me, 0)]
        return root

    def join(self, num: int, den: int, wanted=None):
        """Arrays of pairs of rows of different groups whose bound reaches the overlap asked for; wanted: flags, of a pair one row must have it."""
        if self.root < 0:
            return
        stack = [(self.root, self.root)]
        while stack:
            i, j = stack.pop()
            a, b = self.nodes[i], self.nodes[j]
            if a[3] is not None and a[3] == b[3]:
                continue
            if den * a[2] < num * b[1] or den * b[2] < num * a[1]:
                continue
            if int(np.minimum(a[0], b[0]).sum()) * (num + den) < num * (a[1] + b[1]):
                continue
            if a[5] is None and b[5] is None:
                ra, rb = a[4], b[4]
                sa, sb = self.sizes[ra][:, None], self.sizes[rb][None, :]
                fits = (bound(self.points[ra], self.points[rb]) * (num + den) >= num * (sa + sb)) & (den * np.minimum(sa, sb) >= num * np.maximum(sa, sb)) & (self.group[ra][:, None] != self.group[rb][None, :])
                if i == j:
                    fits &= np.tri(len(ra), k=-1, dtype=bool)
                if wanted is not None:
                    fits &= wanted[ra][:, None] | wanted[rb][None, :]
                x, y = np.nonzero(fits)
                if len(x):
                    yield ra[x], rb[y]
            elif i == j:
                stack += [(a[5], a[5]), (a[6], a[6]), (a[5], a[6])]
            elif b[5] is None or a[5] is not None and len(a[4]) >= len(b[4]):
                stack += [(a[5], j), (a[6], j)]
            else:
                stack += [(i, b[5]), (i, b[6])]


def tree_pairs(sizes: np.ndarray, group: np.ndarray, points: list[np.ndarray], num: int, den: int):
    """Arrays of pairs of a bucket, and the bound as a share of both sizes, by trees: one for each number of groups d, over its own points and the finer ones folded to d."""
    dims = np.array([len(p) for p in points])
    for d in np.unique(dims):
        rows = np.flatnonzero(dims >= d)
        own = dims[rows] == d
        # sizes that no point of d groups can pair with are left out
        lo, hi = sizes[rows][own].min(), sizes[rows][own].max()
        near = own | ((den * sizes[rows] >= num * lo) & (num * sizes[rows] <= den * hi))
        rows, own = rows[near], own[near]
        folded = np.stack([fold(points[r][None, :], d)[0] for r in rows])
        n = sizes[rows]
        for x, y in CountTree(folded, n, group[rows]).join(num, den, own):
            for at in range(0, len(x), 4096):
                i, j = x[at : at + 4096], y[at : at + 4096]
                yield rows[i], rows[j], np.minimum(folded[i], folded[j]).sum(1) / (n[i] + n[j])


def sketch_slots(docs: DataFrame) -> int:
    """Counters for a corpus of this size: one for about 256 bytes of input, as the optimizer estimates it."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_SKETCH, max(SKETCH, 1 << (size // 256).bit_length()))


def _sets(docs: DataFrame, k: int, slots: int) -> DataFrame:
    """doc_id, n, node (name of the set); after the rows of a partition one with its frequency sketch."""
    small_batches(docs.sparkSession)

    def run(batches):
        sketch = np.zeros(slots, np.uint32)
        empty = True
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, _, buf, offs in text_slices(batch):
                sets = shingle_sets(buf, offs, k)
                for d, s in enumerate(sets):
                    n[i + d], node[i + d] = len(s), set_name(s)
                at, count = np.unique(np.concatenate(sets) & np.uint64(slots - 1), return_counts=True)
                sketch[at.astype(np.int64)] += count.astype(np.uint32)
            empty = False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node), pa.nulls(batch.num_rows, pa.binary())], names=["doc_id", "n", "node", "sketch"])
        if not empty:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([zlib.compress(sketch.tobytes(), 1)], pa.binary())], names=["doc_id", "n", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, node long, sketch binary")


def _sum_sketches(rows: DataFrame, slots: int, ws: Workspace) -> np.ndarray:
    """The sum of all partitions' sketches: a tree of sums on the executors, of which the driver gets the root."""
    def run(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                one = np.frombuffer(zlib.decompress(x), np.uint32)
                total = one.copy() if total is None else np.minimum(total.astype(np.uint64) + one, 2**32 - 1).astype(np.uint32)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["sketch"])

    now = rows.where("sketch is not null").select("sketch")
    n, level = now.count(), 0
    while n > FAN:
        n = -(-n // FAN)
        now = ws.write(now.repartition(n).mapInArrow(run, "sketch binary"), f"sketch-{level}")
        level += 1
    total = np.zeros(slots, np.uint64)
    for r in now.toLocalIterator():  # at most FAN, one after another
        total += np.frombuffer(zlib.decompress(r["sketch"]), np.uint32)
    return np.minimum(total, 2**32 - 1).astype(np.uint32)


def _prefixes(docs: DataFrame, k: int, num: int, den: int, sketch) -> DataFrame:
    """(key, node, n) of each set's prefix, and with key null (node, n, point) of each set; a set once for each partition."""
    def run(batches):
        counts, seen = sketch.value, set()
        mask = np.uint64(len(counts) - 1)
        for batch in batches:
            keys, nodes, sizes, pt_nodes, pt_sizes, pts = [], [], [], [], [], []
            for i, _, buf, offs in text_slices(batch):
                for s in shingle_sets(buf, offs, k):
                    if not len(s):
                        continue
                    node = set_name(s)
                    if node in seen:
                        continue
                    seen.add(node)
                    n = len(s)
                    take = n - -(-num * n // den) + 1
                    f = counts[(s & mask).astype(np.int64)]
                    if take < n:
                        low = np.partition(f, take - 1)[take - 1]
                        rare, even = s[f < low], s[f == low]
                        chosen = np.concatenate([rare, even[: take - len(rare)]])  # s is sorted: ties by hash
                    else:
                        chosen = s
                    keys.append(chosen)
                    nodes.append(np.full(take, node))
                    sizes.append(np.full(take, n))
                    pt_nodes.append(node)
                    pt_sizes.append(n)
                    pts.append(point(s).tobytes())
            m = len(pts)
            if not m:
                continue
            key = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(key), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([*nodes, np.array(pt_nodes, np.int64)])),
                pa.array(np.concatenate([*sizes, np.array(pt_sizes, np.int64)])), pa.concat_arrays([pa.nulls(len(key), pa.binary()), pa.array(pts, pa.binary())])], names=["key", "node", "n", "point"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, node long, n long, point binary")


def _if_few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def _sets_of(need: DataFrame, docs: DataFrame, classes: DataFrame, k: int, ws: Workspace, name: str) -> DataFrame:
    """(node, shingles) of the nodes asked for, written as {name}-sets."""
    ids = ws.write(classes.join(need, "node", "left_semi").select("doc_id").distinct(), f"{name}-ids")

    def run(batches):
        for batch in batches:
            nodes, sets = [], []
            for _, _, buf, offs in text_slices(batch):
                for s in shingle_sets(buf, offs, k):
                    nodes.append(set_name(s))
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "node", "shingles"])

    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(_if_few(ids), "doc_id", "left_semi")
    sets = chosen.mapInArrow(run, "doc_id long, node long, shingles binary").join(classes, ["doc_id", "node"], "left_semi").select("node", "shingles")
    return ws.write(sets.dropDuplicates(["node"]), f"{name}-sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, ws: Workspace, name: str) -> DataFrame:
    """The pairs of nodes whose sets are similar enough."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(need, docs, classes, k, ws, name)

    def check(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    with_sets = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    out = ws.write(with_sets.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), f"{name}-links")
    ws.drop(f"{name}-sets")
    return out


def _bucket_pairs(rows: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Pairs (a, b, share) from trees over the points of each (key, block, block); nearest: of each point only the pair with the highest bound in all its trees. Else a tree of more pairs than points gives one row instead: its key, its blocks as one number, and -1."""
    def tree(nodes, sizes, roots, blocks, points, key, i, j):
        """Arrays (a, b, share)."""
        nodes, sizes, roots, blocks = np.array(nodes), np.array(sizes), np.array(roots), np.array(blocks)
        if i != j and (blocks == blocks[0]).all():
            return
        group = np.unique(roots, return_inverse=True)[1]
        best, partner = np.zeros(len(nodes)), np.full(len(nodes), -1)
        every, n = [], 0
        for x, y, share in tree_pairs(sizes, group, points, num, den):
            if i != j:
                keep = blocks[x] != blocks[y]
                x, y, share = x[keep], y[keep], share[keep]
            if not nearest:
                every.append((np.minimum(nodes[x], nodes[y]), np.maximum(nodes[x], nodes[y]), share))
                n += len(x)
                if n > len(nodes):
                    yield np.array([key]), np.array([i << 32 | j]), np.array([-1.0])
                    return
                continue
            for p, q in ((x, y), (y, x)):
                order = np.lexsort((nodes[q], -share, p))
                p, q, r = p[order], q[order], share[order]
                first = np.ones(len(p), bool)
                first[1:] = p[1:] != p[:-1]
                p, q, r = p[first], q[first], r[first]
                up = r > best[p]
                best[p[up]], partner[p[up]] = r[up], q[up]
        yield from every
        x = np.flatnonzero(partner >= 0)
        if len(x):
            yield nodes[x], nodes[partner[x]], best[x]

    def run(batches):
        at, held = None, None

        def flush():
            if held and len(held[0]) > 1:
                for a, b, share in tree(*held, *at):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(share)], names=["a", "b", "share"])

        for batch in batches:
            for key, i, j, block, node, n, root, pt in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (key, i, j):
                    yield from flush()
                    at, held = (key, i, j), ([], [], [], [], [])
                for h, x in zip(held, (node, n, root, block, np.frombuffer(pt, np.uint8))):
                    h.append(x)
        yield from flush()

    found = rows.select("key", "i", "j", "block", "node", "n", "root", "point").mapInArrow(run, "a long, b long, share double")
    if nearest:
        found = found.groupBy("a").agg(F.max(F.struct("share", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.share").alias("share"))
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "share")
    return found


def _forest(nodes, sizes, roots, blocks, subs, points, sets, apart: tuple[bool, bool], num: int, den: int):
    """Pairs of rows whose links join the components of a tree's sets, one for each two that become one: fewer than there are rows. apart: rows of one block, or of one sub-block, are left to other trees."""
    label = np.unique(roots, return_inverse=True)[1]
    offs = np.append(0, np.cumsum([len(s) for s in sets]))
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    number = [number[a:b] for a, b in zip(offs[:-1], offs[1:])]
    mine = np.zeros(offs[-1], bool)
    for x, y, _ in tree_pairs(sizes, label.copy(), points, num, den):
        keep = label[x] != label[y]
        for these, asked in zip((blocks, subs), apart):
            if asked:
                keep &= these[x] != these[y]
        x, y = x[keep], y[keep]
        for u in np.unique(x):
            others = y[x == u]
            others = others[label[others] != label[u]]
            if not len(others):
                continue
            mine[number[u]] = True
            both = np.array([np.count_nonzero(mine[number[v]]) for v in others.tolist()])
            mine[number[u]] = False
            for v in others[den * both >= num * (sizes[u] + sizes[others] - both)].tolist():
                if label[v] != label[u]:
                    label[label == label[v]] = label[u]
                    yield nodes[u], nodes[v]


def _links_within(rows: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, ws: Workspace) -> DataFrame:
    """Links (a, b) that join the components in trees of many pairs, verified where the tree is, so that pairs are not made rows. Trees over HELD shingles are dealt in sub-blocks."""
    of = ["key", "i", "j"]
    rows = ws.write(rows, "dense-rows")
    sets = _sets_of(rows.select("node").distinct(), docs, classes, k, ws, "dense")
    parts = rows.groupBy(*of).agg(F.ceil(F.sum("n") / HELD).cast("int").alias("ns"))
    dealt = rows.join(parts, of).withColumn("sub", F.pmod(F.xxhash64(F.lit("sub"), "node"), F.col("ns")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
    dealt = dealt.withColumn("p", F.least("sub", "other")).withColumn("q", F.greatest("sub", "other")).join(sets, "node")
    of += ["p", "q"]
    dealt = dealt.select(*of, "node", "n", "root", "block", "sub", "point", "shingles").repartition(parts_of(rows.sparkSession), *of).sortWithinPartitions(*of)

    def run(batches):
        at, held = None, []

        def flush():
            if len(held) > 1:
                nodes, sizes, roots, blocks, subs, points, shingles = zip(*held)
                pairs = list(_forest(*map(np.array, (nodes, sizes, roots, blocks, subs)), [np.frombuffer(p, np.uint8) for p in points], [np.frombuffer(s, np.uint64) for s in shingles], (at[1] != at[2], at[3] != at[4]), num, den))
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != row[:5]:
                    yield from flush()
                    at, held = row[:5], []
                held.append(row[5:])
        yield from flush()

    out = ws.write(dealt.mapInArrow(run, "a long, b long").distinct(), "dense-links")
    ws.drop("dense-rows")
    ws.drop("dense-sets")
    return out


def _distinct_buckets(shared: DataFrame) -> DataFrame:
    """The rows (key, node, n) of one bucket of each set of members: near copies share many keys, and equal buckets have equal trees. Members are compared by their number, their ends and 128 bits of hashes."""
    named = shared.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("y"), "node")).alias("y"))
    kept = named.where("low < high").groupBy("c", "low", "high", "x", "y").agg(F.min("key").alias("key")).select("key")
    return shared.join(kept, "key", "left_semi")


def _open(shared: DataFrame, roots: DataFrame | None, step: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The rows of a round with their components, and the buckets whose sets are not all in one yet, with their numbers of blocks."""
    placed = shared.withColumn("root", F.col("node"))
    if roots is not None:
        placed = ws.write(shared.join(_if_few(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), f"{step}-placed")
    if step == "among":
        placed = placed.groupBy("key", "root").agg(F.min(F.struct("node", "n")).alias("m")).select("key", "root", "m.node", "m.n")
    span = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1")
    open_ = ws.write(span.select("key", F.ceil(F.col("size") / (BUCKET if step == "all" else BLOCK)).cast("int").alias("nb")), f"{step}-open")
    return placed, open_


def _dealt(placed: DataFrame, open_: DataFrame, points: DataFrame, step: str) -> DataFrame:
    """The rows of the trees of a round, by (key, i, j)."""
    rows = placed.join(_if_few(open_), "key").join(points.select("node", "point"), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    if step == "all":
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    else:
        rows = rows.withColumn("other", F.col("block"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "root", "point")
    return rows.repartition(parts_of(placed.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of the links with Jaccard similarity of num/den or more."""
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    slots = sketch_slots(docs.select("doc_id", "text"))
    both = ws.write(_sets(docs, k, slots), "sets")
    sketch = spark.sparkContext.broadcast(_sum_sketches(both, slots, ws))
    sets = both.where("n >= 0").select("doc_id", "n", "node")
    classes = ws.write(sets.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")), "classes")
    prefixes = ws.write(_prefixes(docs, k, num, den, sketch), "prefixes")
    rows = prefixes.where("key is not null").select("key", "node", "n")
    # keys are counted alone, so that what is shuffled of most rows is a key and a count
    company = ws.write(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "company")
    held = ws.write(rows.join(_if_few(company), "key").distinct(), "held")
    shared = ws.write(_distinct_buckets(held), "shared")
    ws.drop("held")
    need = shared.select("node").distinct()
    points = ws.write(prefixes.where("key is null").select("node", "n", "point").join(need, "node", "left_semi").dropDuplicates(["node"]), "points")
    ws.drop("prefixes")
    ws.drop("company")
    links, tried, roots = None, None, None
    for step in ("within", "among", "all"):
        placed, open_ = _open(shared, roots, step, ws)
        found = _bucket_pairs(_dealt(placed, open_, points, step), num, den, step != "all")
        if step == "all":
            found = ws.write(found, "found")
            dense = ws.write(found.where("share < 0").select(F.col("a").alias("key"), F.shiftright("b", 32).cast("int").alias("i"), F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("j")), "dense")
            if dense.limit(1).count():
                some = _dealt(placed, open_.join(_if_few(dense.select("key").distinct()), "key", "left_semi"), points, step).join(_if_few(dense), ["key", "i", "j"], "left_semi")
                links = links.union(_links_within(some, docs, classes, k, num, den, ws))
            found = found.where("share >= 0")
        pairs = found.select("a", "b").distinct()
        pairs = ws.write(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), step)
        for name in ("placed", "open"):
            ws.drop(f"{step}-{name}")
        if links is not None and not pairs.limit(1).count():
            continue
        tried = pairs if tried is None else tried.union(pairs)
        verified = _verified(pairs, docs, classes, k, num, den, ws, step)
        links = verified if links is None else links.union(verified)
        if step != "all":
            roots = ws.write(components(links, ws, step), f"{step}-roots")
    ws.drop("shared")
    ws.drop("points")
    # vertices are doc ids from here on
    ids = classes.select("node", "doc_id")
    all_links = links.join(ids.select(F.col("node").alias("a"), F.col("doc_id").alias("da")), "a").join(ids.select(F.col("node").alias("b"), F.col("doc_id").alias("db")), "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    repeated = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").limit(1).count()
    if repeated:  # a doc_id with several texts joins their classes, so copies are edges too
        copies = sets.where("doc_id is not null").join(ids.withColumnRenamed("doc_id", "class_id"), "node").where("doc_id <> class_id").select(F.col("class_id").alias("b"), F.col("doc_id").alias("a"))
        moved, by = ws.write(components(all_links.unionByName(copies), ws, "final").where("node <> root"), "components").select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")), "doc_id"
    else:  # only sets that have copies or links have another id than their document's
        roots = components(all_links, ws, "final").select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))
        joined = classes.join(roots, "doc_id", "left").where("copies > 1 or component_id is not null")
        moved, by = ws.write(joined.select("node", F.coalesce("component_id", "doc_id").alias("component_id")), "components"), "node"
    ws.drop("classes")
    out = sets.join(_if_few(moved), by, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs without near-duplicates, with all their columns: of each component the smallest doc_id stays; null ids stay."""
    found = jaccard_components(docs.select("doc_id", "text"), k, num, den)
    going = Workspace(docs.sparkSession, "near-copies").write(found.where("doc_id <> component_id").select("doc_id").distinct(), "going")
    return docs.join(_if_few(going), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
