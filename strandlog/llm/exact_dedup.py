"""Operator 4: exact deduplication by progressive refinement.

Texts are equal when identical after lower-casing A-Z. Level 1 groups by length in bytes, level 2
by a hash of the first characters, and only texts whose group still has company are read and hashed
in full (SHA-256) and grouped by that. Levels 1 and 2 shuffle counts of keys, level 3 hashes with
the largest id, all of them pre-aggregated on the map side; a text without company never leaves its
task. Each level's surviving keys are broadcast while they are few (``BROADCAST_KEYS``), so that no
row moves at all; beyond that the rows with company, and only those, are joined by a shuffle, which
the join may split where one key has very many. Texts take part in that only if the caller selects them.

Of equal texts the row with the largest doc_id stays; null ids rank below all others. A null text
counts as empty. Rows that repeat both id and text are one document: they are kept or dropped
together. An empty table gives an empty result. Further columns are carried, whatever their names,
but exact_groups drops those called as its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import UPPER, Workspace, free_names, lower_ascii

#: Characters hashed at level 2.
PREFIX = 256
#: Surviving keys (16 bytes each) and groups (48 bytes each) are broadcast up to this number; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def _length():
    return F.coalesce(F.octet_length("text"), F.lit(0))


def _prefix():
    return F.xxhash64(F.translate(F.coalesce(F.substring("text", 1, PREFIX), F.lit("")), UPPER, UPPER.lower()))


def _digest():
    return F.sha2(lower_ascii(F.col("text")), 256)


def survivors(docs: DataFrame) -> DataFrame:
    """(size, prefix) shared by more than one row: level 2 counts only rows that have company at level 1."""
    level2 = docs.select(_length().alias("size"), _prefix().alias("prefix")).groupBy("size", "prefix").agg(F.count("*").alias("n"))
    level1 = level2.groupBy("size").agg(F.sum("n").alias("m")).where("m > 1").select("size")
    return level2.where("n > 1").join(level1, "size", "left_semi").select("size", "prefix")


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def _grouped(docs: DataFrame, full: Column) -> tuple[DataFrame, tuple[str, str]]:
    """docs with the largest id and the size of the group of every row that has copies, under free names; full: the full hash."""
    ws = Workspace(docs.sparkSession, "exact-dedup")
    size, prefix, shared, digest, keep, n = free_names(docs, 6)
    keys = ws.write(survivors(docs), "keys")
    few = _few(keys)
    known = keys.select(F.col("size").alias(size), F.col("prefix").alias(prefix), F.lit(True).alias(shared))
    keyed = docs.withColumn(size, _length()).withColumn(prefix, _prefix())
    marked = keyed.join(F.broadcast(known) if few else known, [size, prefix], "left").drop(size, prefix)
    # only survivors are hashed in full
    marked = marked.withColumn(digest, F.when(F.col(shared), full)).drop(shared)
    with_company = marked.where(F.col(digest).isNotNull())
    groups = with_company.groupBy(digest).agg(F.max("doc_id").alias(keep), F.count("*").alias(n)).where(F.col(n) > 1)
    groups = ws.write(groups, "groups")
    if _few(groups):
        return marked.join(F.broadcast(groups), digest, "left"), (keep, n)
    lone = marked.where(F.col(digest).isNull())
    for name in (keep, n):
        lone = lone.withColumn(name, F.lit(None).cast(groups.schema[name].dataType))
    return with_company.join(groups, digest, "left").unionByName(lone), (keep, n)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256 (of the lower-cased text), beside its own columns."""
    own = [c for c in docs.columns if c.lower() not in RESULTS]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    sha = free_names(docs, 1)[0]
    grouped, (keep, n) = _grouped(docs.withColumn(sha, _digest()), F.col(sha))
    kept_id = F.when(F.col(n).isNull(), F.col("doc_id")).otherwise(F.col(keep))
    return grouped.select(*[F.col(f"`{c}`") for c in own], kept_id.alias("keep_id"), F.coalesce(n, F.lit(1)).cast("long").alias("group_size"), kept_id.eqNullSafe(F.col("doc_id")).alias("kept"), F.col(sha).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of docs."""
    grouped, (keep, n) = _grouped(docs, _digest())
    return grouped.where(F.col(n).isNull() | F.col(keep).eqNullSafe(F.col("doc_id"))).select(*[F.col(f"`{c}`") for c in docs.columns])
