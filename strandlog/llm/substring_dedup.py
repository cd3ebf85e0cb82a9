"""Operator 6: substring deduplication with a log-structured fingerprint index.

A window is ``size`` consecutive words of a document; a window is a copy when its word sequence
also starts in a document with a smaller doc_id, and every word that a copy covers is removed.

The index is a set of immutable Parquet runs of (fingerprint, doc_id), each sorted by
fingerprint; a new batch of documents is merge-joined with all runs, becomes a run itself, and
runs are compacted when there are too many. A fingerprint is the smallest hash among the
``size - gram + 1`` word grams of a window: two equal windows have the same one, and a text has
about one for every 18 words, so the index holds a small part of all windows and still misses
none. Windows whose fingerprint occurs in another document are then verified: their full
128-bit hashes (two of 64 bits, from separate hashes of the words) are grouped for the smallest doc_id, in the new batch and in those historical
documents that share the fingerprint.

Defined results: null and empty texts have no words; rows with a null doc_id have no place in
the order, so nothing is removed from them and they remove nothing; rows that repeat a doc_id
are judged each, and do not make each other copies; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.common import Workspace, parts_of, shingle_hashes, small_batches, split_words, text_slices, word_hashes

#: Document ids that are broadcast to pick rows at the scan (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000


def window_minima(words: np.ndarray, first: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the smallest gram hash inside, and whether the window lies in one text."""
    grams, _ = shingle_hashes(words, first, gram)
    span, n = size - gram + 1, len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    low, have = grams, 1
    while 2 * have <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[:n], low[span - have : span - have + n])
    inside = np.ones(n, bool)
    for b in np.unique(first[(first > 0) & (first < len(words))]):
        inside[max(0, b - size + 1) : b] = False
    return low, inside


def fingerprints(docs: DataFrame, size: int = 50, gram: int = 16) -> DataFrame:
    """Distinct (fingerprint, doc_id) of the documents."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows, fps = [], []
            for i, _, buf, offs in text_slices(batch):
                starts, ends, first = split_words(buf, offs)
                low, inside = window_minima(word_hashes(buf, starts, ends, False), first, size, gram)
                new = np.ones(len(low), bool)
                new[1:] = low[1:] != low[:-1]
                new[first[(first > 0) & (first < len(low))]] = True
                at = np.flatnonzero(new & inside)
                of = np.searchsorted(first, at, "right") - 1
                order = np.lexsort((low[at], of))
                f, d = low[at][order], of[order]
                keep = np.ones(len(f), bool)
                keep[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                rows.append(d[keep] + i)
                fps.append(f[keep])
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            fps = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), batch.column(0).take(pa.array(rows))], names=["fingerprint", "doc_id"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "fingerprint long, doc_id long")


class FingerprintIndex:
    """Sorted immutable runs of (fingerprint, doc_id) below one folder; state is in ``runs``, a list of their paths."""

    SCHEMA = "fingerprint long, doc_id long"

    def __init__(self, spark: SparkSession, path: str, runs: list[str] | None = None, max_runs: int = 2):
        self.spark, self.path, self.runs, self.max_runs = spark, path, list(runs or []), max_runs

    def read(self, runs: list[str] | None = None) -> DataFrame:
        runs = self.runs if runs is None else runs
        return self.spark.read.schema(self.SCHEMA).parquet(*runs) if runs else self.spark.createDataFrame([], self.SCHEMA)

    def _write(self, rows: DataFrame) -> str:
        out = f"{self.path}/run-{uuid.uuid4().hex}"
        rows.repartitionByRange(parts_of(self.spark), "fingerprint", "doc_id").sortWithinPartitions("fingerprint", "doc_id").write.option("compression", "zstd").parquet(out)
        return out

    def append(self, rows: DataFrame) -> str:
        """Writes a new run and gives its path; ``compact`` is the caller's."""
        self.runs.append(self._write(rows))
        return self.runs[-1]

    def compact(self) -> None:
        """One sorted run in place of all; the old ones go once the new one is complete."""
        if len(self.runs) < 2:
            return
        old, new = self.runs, self._write(self.read().distinct())
        self.runs = [new]
        for run in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(run)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs with these ids: at the scan while the ids are few enough to broadcast."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def copied_windows(batch: DataFrame, history: DataFrame | None, index: FingerprintIndex, size: int = 50, gram: int = 16) -> DataFrame:
    """Adds a batch to the index; (doc_id, text_key, position) of each window of the batch that is a copy.

    Ids of the batch are larger than all in the index; history: the documents that the index was built from.
    """
    spark = batch.sparkSession
    ws = Workspace(spark, "windows")
    earlier = list(index.runs)
    run = index.read([index.append(fingerprints(batch, size, gram))])
    span = run.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    both = run
    if earlier:
        old = index.read(earlier)
        known = old.select("fingerprint").distinct().withColumn("known", F.lit(True))
        span = span.join(known, "fingerprint", "left").where("low < high or known")
        both = run.union(old)
    else:
        span = span.where("low < high")
    span = ws.write(span.select("fingerprint"), "shared")
    shared = both.join(span, "fingerprint", "left_semi").groupBy("doc_id").agg(F.collect_set("fingerprint").alias("fps"))
    shared = ws.write(shared, "by_document")
    ws.drop("shared")
    keyed = lambda d: d.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    docs = keyed(batch) if not earlier or history is None else keyed(batch).union(keyed(history))
    docs = _of_ids(docs, shared.select("doc_id")).withColumn("text_key", F.xxhash64("text")).join(shared, "doc_id")

    def run_windows(batches):
        for b in batches:
            rows, at_all, h1, h2 = [], [], [], []
            for i, j, buf, offs in text_slices(b):
                starts, ends, first = split_words(buf, offs)
                words = word_hashes(buf, starts, ends, False)
                low, inside = window_minima(words, first, size, gram)
                if not len(low):
                    continue
                a, _ = shingle_hashes(words, first, size)
                c, _ = shingle_hashes(word_hashes(buf, starts, ends, False, other=True), first, size, salt=1)
                for d in range(i, j):
                    s, e = int(first[d - i]), int(first[d - i + 1]) - size + 1
                    if e <= s:
                        continue
                    fps = np.sort(b.column(3)[d].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    near = np.minimum(np.searchsorted(fps, low[s:e]), len(fps) - 1)
                    at = np.flatnonzero(fps[near] == low[s:e])
                    rows.append(np.full(len(at), d))
                    at_all.append(at)
                    h1.append(a[s:e][at])
                    h2.append(c[s:e][at])
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            take = pa.array(cat(rows, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(cat(at_all, np.int64).astype(np.int32)), pa.array(cat(h1, np.uint64).view(np.int64)), pa.array(cat(h2, np.uint64).view(np.int64))], names=["doc_id", "text_key", "position", "h1", "h2"])

    windows = docs.select("doc_id", "text", "text_key", "fps").mapInArrow(run_windows, "doc_id long, text_key long, position int, h1 long, h2 long")
    windows = ws.write(windows, "windows")
    ws.drop("by_document")
    first_owner = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    # a table of its own: the join below then is between two exchanges, and a passage of many documents can be split
    first_owner = ws.write(first_owner, "owners")
    copies = windows.join(first_owner, ["h1", "h2"]).where("doc_id > owner").select("doc_id", "text_key", "position")
    if earlier:  # historical windows were judged with their own batch
        least = batch.agg(F.min("doc_id")).first()[0]
        copies = copies.where(F.col("doc_id") >= F.lit(least))
    copies = ws.write(copies.groupBy("doc_id", "text_key").agg(F.collect_list("position").alias("positions")), "copies")
    ws.drop("windows")
    ws.drop("owners")
    return copies


def remove_copies(docs: DataFrame, copies: DataFrame, size: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row of docs."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    ids = copies.select("doc_id")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = ids.distinct()
    ids = F.broadcast(ids) if few else ids
    none = F.array().cast("array<int>").alias("positions")
    with_copies = keyed.join(ids, "doc_id", "left_semi").join(copies, ["doc_id", "text_key"], "left").select("doc_id", "text", F.coalesce("positions", none).alias("positions"))
    rest = keyed.join(ids, "doc_id", "left_anti").select("doc_id", "text", none)

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, positions in zip(b.column(1).to_pylist(), b.column(2)):
                words = text.encode().split()
                n_words.append(len(words))
                if len(positions.values):
                    cover = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(positions.values.to_numpy(zero_copy_only=False))
                    cover[at] += 1
                    np.add.at(cover, at + size, -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    n_removed.append(int((~stay).sum()))
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_copies.union(rest).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, size: int = 50, gram: int = 16, batches: int = 3) -> DataFrame:
    """All documents in batches of ascending ids through one index, then the words that stay. With three batches the last one is joined with a compacted run."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, Workspace(spark, "index").path)
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    if low is None:
        return remove_copies(docs, spark.createDataFrame([], "doc_id long, text_key long, positions array<int>"), size)
    edges = sorted({low + (high - low + 1) * i // batches for i in range(batches)} | {high + 1})
    copies, history = None, None
    for a, b in zip(edges[:-1], edges[1:]):
        batch = docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))
        found = copied_windows(batch, history, index, size, gram)
        copies = found if copies is None else copies.union(found)
        history = batch if history is None else docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < b))
        if len(index.runs) >= index.max_runs and b <= high:  # the next batch reads the compacted run
            index.compact()
    return remove_copies(docs, copies, size)
