"""Operator 8: token ids in Parquet list columns, for selective reads of tokens and metadata.

Documents are range-partitioned and sorted by id, encoded, and written as ``doc_id, part,
local_start, n_tokens, ids list<int>``. Ids are dictionary-encoded (16-bit codes for a 50k
vocabulary), the ascending columns delta-encoded (Parquet format 2); row groups and pages have
fixed target sizes and carry column indexes, so that a filter on doc_id reads few pages and a
query for the metadata never reads ids.

Defined results: a null text is empty and has only the end id; an empty table gives an empty
file set; rows that repeat a doc_id are all kept, in order of their text; null ids come first;
further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm import tokens
from strandlog.llm.common import parts_of, small_batches

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2_000


def encode_ordered(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """The rows of the token files, sorted by doc_id within range partitions."""
    spark, path = docs.sparkSession, path or tokens.default_path()
    small_batches(spark)

    def run(batches):
        enc, part, at = tokens.encoder(path), TaskContext.get().partitionId(), 0
        for batch in tokens.gathered(batches):
            coded, first = enc.encode_ended(batch.column(1), end_id)
            n, ends = np.diff(first), at + first[1:]
            at += len(coded)
            ids = pa.ListArray.from_arrays(first.astype(np.int32), coded.view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), ids], names=["doc_id", "part", "local_start", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts_of(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, FILE_SCHEMA)


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2) -> None:
    (encode_ordered(docs, path, end_id).write.mode("overwrite").option("compression", "zstd")
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(out))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The files' rows; filters and column choices go down to the scan."""
    return spark.read.schema(FILE_SCHEMA).parquet(out)


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids in all earlier files. One row for each part, from the files' metadata columns."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("ids_of_part"))
    return totals.select("part", (F.sum("ids_of_part").over(Window.orderBy("part")) - F.col("ids_of_part")).alias("part_start"))


def digest_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, read back from the files."""
    import zlib

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            offs = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1], offs[1:])), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offs).astype(np.int64)), pa.array(crc)], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    small_batches(files.sparkSession)
    read = files.select("doc_id", "part", "local_start", "ids").mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return read.join(part_starts(files), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
