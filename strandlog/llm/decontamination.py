"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

Texts are sets of hashed k-word shingles (A-Z lower-cased). A document leaks an item when it
contains at least ``num/den`` of the item's shingles. Items are partitioned by the power of two
of their size, each partition with an index of its own, and a text is searched only in the
partitions whose items can fit into it; an item of n shingles is indexed under its t = n - ceil(n*num/den) + 1 smallest
hashes, its bottom-t MinHash sketch, so a document that holds enough of the item cannot miss all
of them: the search has recall 1. Candidates are then verified by exact shingle containment.

The index is broadcast in blocks of items of at most ``block`` shingles, each a pass over the
documents; documents are neither shuffled nor cut, and a hot document or source stays where it is.

Defined results: items and documents without words match nothing; a text of fewer words than k
is one shingle, its whole sequence; an item that short can only match a document that is that
sequence. Null texts are empty; null item ids are kept; repeated items give repeated pairs with
their own ids (equal rows once); repeated documents are reported each; an empty benchmark or
empty documents give no pairs; in drop_leaks each repeated row is kept or dropped for itself, and
further columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import shingle_hashes, shingle_sets, small_batches, split_words, text_slices, word_hashes

#: Shingles of the items that are broadcast together: 8 bytes each and as much again for the sketches.
BLOCK = 2_000_000


class Partition:
    """The sketches of the items of one size: sorted hashes, and the items that have each in their sketch."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], which: np.ndarray, need: np.ndarray):
        sketches = [items[i][1][: len(items[i][1]) - need[i] + 1] for i in which]
        keys, owners = np.concatenate(sketches), np.repeat(which, [len(s) for s in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.least = keys[order], owners[order], int(need[which].min())
        self.distinct = np.unique(self.keys)


class Index:
    """Sketches of a block of items, by partitions of item size."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], num: int, den: int):
        self.items = [i for i in items if len(i[1])]
        size = np.array([len(s) for _, s in self.items], np.int64)
        self.need = -(-size * num // den)
        step = np.array([int(n).bit_length() for n in size], np.int64)
        self.partitions = [Partition(self.items, np.flatnonzero(step == p), self.need) for p in np.unique(step)]
        self.distinct = np.unique(np.concatenate([p.distinct for p in self.partitions])) if self.partitions else np.zeros(0, np.uint64)
        self.marks = np.zeros(1 << 22, bool)
        self.marks[self._slot(self.distinct)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.marks) - 1)).astype(np.int64)

    def texts_hit(self, buf: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(text, its shingles) of the texts that hold any sketch hash; most hold none and get no set."""
        starts, ends, first = split_words(buf, offs)
        words = word_hashes(buf, starts, ends, True)
        h, inside = shingle_hashes(words, first, k)
        at = np.flatnonzero(self.marks[self._slot(h)] & inside) if len(h) else np.zeros(0, np.int64)
        if len(at):
            near = np.minimum(np.searchsorted(self.distinct, h[at]), len(self.distinct) - 1)
            at = at[self.distinct[near] == h[at]]
        count = np.diff(first)
        hit = np.union1d(np.searchsorted(first, at, "right") - 1, np.flatnonzero((count > 0) & (count < k)))
        for d in hit.astype(np.int64):
            a, b = int(first[d]), int(first[d + 1])
            yield int(d), np.unique(h[a : b - k + 1]) if b - a >= k else shingle_hashes(words[a:b], np.array([0, b - a]), b - a)[0]

    def search(self, shingles: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of every item that these distinct sorted shingles contain far enough."""
        for p in self.partitions if len(shingles) else ():
            if p.least > len(shingles):  # no item of this size fits into so short a text, nor does a larger one
                return
            at = np.minimum(np.searchsorted(shingles, p.distinct), len(shingles) - 1)
            hit = p.distinct[shingles[at] == p.distinct]
            if not len(hit):
                continue
            lo, hi = np.searchsorted(p.keys, hit, "left"), np.searchsorted(p.keys, hit, "right")
            for i in np.unique(np.concatenate([p.owners[a:b] for a, b in zip(lo, hi)])):
                item = self.items[i][1]
                at = np.minimum(np.searchsorted(shingles, item), len(shingles) - 1)
                shared = int((shingles[at] == item).sum())
                if shared >= self.need[i]:
                    yield int(i), shared


def blocks(benchmark: DataFrame, k: int, block: int) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items with their shingles, made on the executors and streamed to the driver one partition at a time, in blocks of bounded size."""
    small_batches(benchmark.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for _, _, buf, offs in text_slices(batch) for s in shingle_sets(buf, offs, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["item_id", "shingles"])

    now, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    for row in rows.mapInArrow(run, "item_id long, shingles binary").toLocalIterator():
        shingles = np.frombuffer(row["shingles"], np.uint64)
        now.append((row["item_id"], shingles))
        size += len(shingles)
        if size >= block:
            yield now
            now, size = [], 0
    if now:
        yield now


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 4, den: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of every document that contains num/den or more of an item."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, n_shared long, n_item long"

    def run_for(shared_index):
        def run(batches):
            index = shared_index.value
            for batch in batches:
                rows, items, shared, sizes = [], [], [], []
                for i, _, buf, offs in text_slices(batch):
                    for d, shingles in index.texts_hit(buf, offs, k):
                        for item, n in index.search(shingles):
                            rows.append(i + d)
                            items.append(index.items[item][0])
                            shared.append(n)
                            sizes.append(len(index.items[item][1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "item_id", "n_shared", "n_item"])
        return run

    out = None
    for items in blocks(benchmark, k, block):
        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run_for(spark.sparkContext.broadcast(Index(items, num, den))), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 4, den: int = 5, block: int = BLOCK) -> DataFrame:
    """The rows of docs that contain no item far enough, with their own columns; one pass for each block of items, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)

    def run_for(shared_index):
        def run(batches):
            index = shared_index.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, buf, offs in text_slices(batch):
                    for d, shingles in index.texts_hit(buf, offs, k):
                        clean[i + d] = next(index.search(shingles), None) is None
                yield batch.filter(pa.array(clean))
        return run

    for items in blocks(benchmark, k, block):
        docs = docs.mapInArrow(run_for(spark.sparkContext.broadcast(Index(items, num, den))), docs.schema)
    return docs
