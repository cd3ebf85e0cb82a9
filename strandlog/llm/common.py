"""Shared parts of the training-data operators: scratch tables, word splitting and hashing.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, which is what ``bytes.split()`` and ``[^\\x20\\x09-\\x0D]+`` both give.
Everything here works on whole Arrow batches with numpy; no text is cut or sampled.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch sent to Python: a few MB of ordinary texts; memory then follows the longest texts only.
BATCH_ROWS = 256
#: Bytes of text that numpy works on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.random.default_rng(20240501)
_TABLE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_OTHER = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_SHINGLE_BASE = np.uint64(0xD6E8FEB86659FD93)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage that the cluster names; a folder of our own only where none is set and all runs in one JVM, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = getattr(spark, "_strandlog_scratch", None) or tempfile.mkdtemp(prefix="strandlog-")
        spark._strandlog_scratch = root
        spark.sparkContext.setCheckpointDir(root)
    return root


class Workspace:
    """Tables of one operator call in the shared scratch folder; they cut lineage and outlive lost executors.

    ``drop`` removes a table that nothing reads any more. What the returned (lazy) DataFrame reads
    stays in the folder, which is scratch space of the cluster.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/strandlog-{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """n column names that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    return [x for x in (f"_own{i}" for i in range(n + len(taken))) if x not in taken][:n]


def small_batches(spark: SparkSession) -> None:
    """Sends Python fewer rows at once, as texts can be long; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of a batch; null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + (size or SLICE_BYTES), "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def split_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    space = _SPACE[buf]
    cut = offs[1:-1]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[cut[cut < len(buf)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[cut[cut > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; tables above 8 MB are not kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 2**64))])
        out.append(p[:n])
    if n <= 1 << 20 | 1:
        _powers = out[0], out[1]
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, lower-cased A-Z if asked; other: one by another table of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_OTHER if other else _TABLE)[_LOWER[buf] if lower else buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they all lie in one text (first: from split_words)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    base = np.uint64((int(_SHINGLE_BASE) + 2 * salt) % 2**64)
    if k <= 8:
        h = words[: n - k + 1].copy()
        for i in range(1, k):
            h = h * base + words[i : n - k + 1 + i]
    else:  # by doubling: the hash of 2m words from those of m words
        h, have, out, taken = words, 1, None, 0
        rest = k
        while rest:
            if rest & 1:
                if out is None:
                    out, taken = h, have
                else:
                    m = n - (taken + have) + 1
                    out = out[:m] * np.uint64(pow(int(base), have, 2**64)) + h[taken : taken + m]
                    taken += have
            rest >>= 1
            if rest:
                m = n - 2 * have + 1
                h = h[:m] * np.uint64(pow(int(base), have, 2**64)) + h[have : have + m]
                have *= 2
        h = out[: n - k + 1]
    inside = np.ones(n - k + 1, bool)
    for b in np.unique(first[(first > 0) & (first < n)]):
        inside[max(0, b - k + 1) : b] = False
    return mix(h + np.uint64(k)), inside


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int, lower: bool = True) -> list[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; of 1 to k-1 words, the whole sequence as one; else empty."""
    starts, ends, first = split_words(buf, offs)
    words = word_hashes(buf, starts, ends, lower)
    h, _ = shingle_hashes(words, first, k)
    out = []
    for d in range(len(offs) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            short, _ = shingle_hashes(words[a:b], np.array([0, b - a]), b - a)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def replace_columns(batch: pa.RecordBatch, names: list[str], extra: dict[str, pa.Array], rows=None) -> pa.RecordBatch:
    """The named columns of a batch (of the given rows) with further ones."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
    if rows is not None:
        cols = [c.take(pa.array(rows)) for c in cols]
    return pa.RecordBatch.from_arrays([*cols, *extra.values()], names=[*names, *extra])
