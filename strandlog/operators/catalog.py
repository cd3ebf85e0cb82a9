"""Template tables: upserts, ids, look-ups and saved matchers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.operators.matcher import Matcher
from strandlog.plans.config import MatcherConfig
from strandlog.plans.schema import TEMPLATE


def max_template_id(templates: DataFrame) -> DataFrame:
    return templates.agg(F.coalesce(F.max("template_id"), F.lit(0).cast("long")).alias("max_template_id"))


def assign_ids(new: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Rows with id 0 get the ids after the largest known one, in the given order; for a single writer. New rows are a batch, not a corpus."""
    after = max_template_id(known)
    rank = F.row_number().over(Window.partitionBy(F.col("template_id") == 0).orderBy(order))
    return new.crossJoin(F.broadcast(after)).withColumn("template_id", F.when(F.col("template_id") == 0, F.col("max_template_id") + rank).otherwise(F.col("template_id"))).drop("max_template_id")


def upsert(templates: DataFrame, version: str = "version") -> DataFrame:
    """Of the rows of each template the one with the highest version."""
    cols = [c for c in templates.columns if c not in ("template_id",)]
    newest = templates.groupBy("template_id").agg(F.max_by(F.struct(*cols), version).alias("r"))
    return newest.select("template_id", "r.*")


def templates_for_stream(templates: DataFrame, org_id: str, log_stream_id: str) -> DataFrame:
    return templates.where((F.col("org_id") == org_id) & (F.col("log_stream_id") == log_stream_id)).orderBy("template_id")


def rekey(templates: DataFrame) -> DataFrame:
    """Fresh ids in order of dataset and place: (new_template_id beside the old columns). Catalogues are bounded."""
    return templates.withColumn("new_template_id", F.row_number().over(Window.orderBy("dataset", "pos")).cast("long"))


def from_ground_truth(rows: DataFrame) -> DataFrame:
    """(event_id, template): the last template given for each event."""
    return rows.where("expected_template is not null").groupBy("event_id").agg(F.max_by("expected_template", "line_id").alias("template"))


def save_json(matcher: Matcher, spark: SparkSession, path: str) -> None:
    """One row: next_template_id and templates."""
    rows = matcher.dataframe(spark).select(F.collect_list(F.struct("template_id", "pattern", "variables", "example")).alias("templates"))
    rows.select(F.lit(matcher.next_id).cast("long").alias("next_template_id"), "templates").coalesce(1).write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str) -> Matcher:
    """A saved matcher: no seeds, default options. Also reads catalogue files, whose next id may be missing."""
    from strandlog.plans.schema import CATALOGUE_FILE

    row = spark.read.schema(CATALOGUE_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).first()
    if row is None or row["templates"] is None:
        raise ValueError(f"{path} holds no template catalogue")
    return Matcher.from_rows([t.asDict() for t in row["templates"]], MatcherConfig(), row["next_template_id"])


def save_table(matcher: Matcher, spark: SparkSession, path: str) -> None:
    """The compact form: Parquet, with the options and the next id beside each row."""
    meta = json.dumps({"next_id": matcher.next_id})
    matcher.dataframe(spark).withColumn("meta", F.lit(meta)).coalesce(1).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> Matcher:
    rows = [r.asDict() for r in spark.read.schema(f"{TEMPLATE}, meta string").parquet(path).toLocalIterator()]
    next_id = json.loads(rows[0]["meta"])["next_id"] if rows else 1
    return Matcher.from_rows(rows, MatcherConfig(), next_id)
