"""Readers of log files, labelled logs and template catalogues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.templates import loghub_regex
from strandlog.plans.schema import CATALOGUE_FILE, GROUND_TRUTH


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id from 0, message) of a text file or folder.

    Numbers follow the order of files and lines: lines are counted by partition, and each partition's numbers begin
    after those of the ones before it. Only the counts, one for each partition, come together.
    """
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    parts = F.shiftright(F.col("id"), 33)
    counts = lines.groupBy(parts.alias("part")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    numbered = lines.withColumn("part", parts).join(F.broadcast(starts), "part")  # a row for each input partition
    return numbered.select((F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("line_id"), F.col("value").alias("message"))


def structured_csv(spark: SparkSession, path: str) -> DataFrame:
    """(line_id from 0, event_id) of a labelled file by the columns LineId and EventId of its header."""
    return spark.read.option("header", True).csv(path).select((F.col("LineId").cast("long") - 1).alias("line_id"), F.col("EventId").alias("event_id"))


def template_csv(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, template, pattern): EventId, EventTemplate by header, quoted commas allowed."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template"), loghub_regex(F.col("EventTemplate")).alias("pattern"))


def _body(spark: SparkSession, path: str, header: bool) -> DataFrame:
    lines = raw_lines(spark, path)
    return lines.where("line_id > 0").withColumn("line_id", F.col("line_id") - 1) if header else lines


def naive_template_csv(spark: SparkSession, path: str) -> DataFrame:
    """Compatible with files whose templates hold bare commas: one cut at the first comma, outer quotes off."""
    cut = F.split("message", ",", 2)
    return _body(spark, path, True).where(F.size(cut) == 2).select(F.trim(cut[0]).alias("event_id"), F.trim(F.regexp_replace(cut[1], r'^"+|"+$', "")).alias("template"))


def positional_csv(spark: SparkSession, path: str, templates: DataFrame, line_column: int = 1, event_column: int = 9, cuts: int = 11) -> DataFrame:
    """Ground truth from a file cut at its first commas, quotes ignored; rows with too few fields are dropped. Templates are a catalogue and looked up by a left join."""
    cut = F.split("message", ",", cuts)
    rows = _body(spark, path, True).where(F.size(cut) > event_column).select("line_id", cut[line_column].alias("log_line"), cut[event_column].alias("event_id"))
    return rows.join(templates.select("event_id", F.col("template").alias("expected_template")), "event_id", "left").select("line_id", "log_line", "event_id", "expected_template")


def generic_csv(spark: SparkSession, path: str, header: bool = True, naive: bool = False) -> DataFrame:
    """Ground truth from log, event and, if there, template columns, by position; rows with fewer than two fields are dropped."""
    if naive:
        cut = F.split("message", ",", 3)
        rows = _body(spark, path, header).where(F.size(cut) >= 2)
        return rows.select("line_id", cut[0].alias("log_line"), F.trim(cut[1]).alias("event_id"), F.trim(F.get(cut, F.lit(2))).alias("expected_template"))
    rows = _body(spark, path, header).select("line_id", F.from_csv("message", F.lit("log_line string, event_id string, expected_template string"), {"escape": '"'}).alias("r"))
    return rows.select("line_id", "r.*").where("event_id is not null")


def catalogue_json(spark: SparkSession, path: str) -> DataFrame:
    """Templates of catalogue files, with the dataset that each file's name tells; files of another shape give no rows."""
    rows = spark.read.schema(CATALOGUE_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"(_templates_with_anchors|_templates)?\.json$", "")
    return rows.withColumn("dataset", name).select("dataset", F.posexplode("templates").alias("pos", "t")).select("dataset", "pos", "t.*")


def stream_catalogue(spark: SparkSession, path: str, org_id: str) -> DataFrame:
    """Catalogue files as rows of the template table, one stream for each file."""
    return catalogue_json(spark, path).select(F.lit(org_id).alias("org_id"), F.concat(F.lit("cache-"), "dataset").alias("log_stream_id"), "template_id", "pattern", "variables", "example", F.current_timestamp().alias("created_at"))


def dataset_names(files: list[str]) -> list[str]:
    """Names of datasets that have a catalogue file, first letter upper, sorted."""
    found = (re.fullmatch(r"(?:.*/)?([^/]+)_templates\.json", f) for f in files)
    return sorted(m[1][:1].upper() + m[1][1:] for m in found if m)


# A small labelled sample.
SAMPLE = (
    ("User alice logged in from 192.168.1.1", "LOGIN", "User <*> logged in from <*>"), ("User bob logged in from 192.168.1.2", "LOGIN", "User <*> logged in from <*>"),
    ("Error: Connection timeout after 30s", "ERROR", "Error: <*>"), ("User charlie logged in from 192.168.1.3", "LOGIN", "User <*> logged in from <*>"), ("Error: Disk full on /dev/sda1", "ERROR", "Error: <*>"),
)


def in_memory(spark: SparkSession, rows=SAMPLE) -> DataFrame:
    """Ground truth from (line, event, template) tuples."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], GROUND_TRUTH)
