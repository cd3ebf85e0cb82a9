"""Log and template tables: queries and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.plans import schema

LOG_COLUMNS = ["org_id", "log_stream_id", "service", "region", "log_stream_name", "timestamp", "template_id", "message"]


def read(spark: SparkSession, path: str, ddl: str = schema.LOGS) -> DataFrame:
    return spark.read.schema(ddl).parquet(path)


def in_range(logs: DataFrame, org_id: str, log_stream_id: str, start: str, end: str) -> DataFrame:
    """Rows of a stream between two instants, both included; the conditions reach the scan."""
    at = F.col("timestamp")
    return logs.where((F.col("org_id") == org_id) & (F.col("log_stream_id") == log_stream_id) & (at >= F.lit(start).cast(logs.schema["timestamp"].dataType)) & (at <= F.lit(end).cast(logs.schema["timestamp"].dataType)))


def query_logs(logs: DataFrame, org_id: str, log_stream_id: str, start: str, end: str, limit: int = 10_000, tie: str = "line_id") -> DataFrame:
    """Newest first, at most ``limit`` rows."""
    return in_range(logs, org_id, log_stream_id, start, end).orderBy(F.desc("timestamp"), tie).limit(limit)


def query_logs_grouped(logs: DataFrame, org_id: str, log_stream_id: str, start: str, end: str, samples: int = 5, limit: int = 20, tie: str = "line_id") -> DataFrame:
    """The largest templates with their counts and first messages; unmatched lines are the group ''.

    Samples are a running top-k of each template before anything is collected: ranked rows beyond the samples are
    dropped within the partition (a window group limit), so a hot template is not gathered into one array.
    """
    rows = in_range(logs, org_id, log_stream_id, start, end).select(F.coalesce(F.col("template_id").cast("string"), F.lit("")).alias("template_id"), "timestamp", tie, "message")
    top = rows.groupBy("template_id").agg(F.count("*").alias("log_count")).orderBy(F.desc("log_count"), "template_id").limit(limit)
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy("timestamp", tie))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= samples).groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct("rank", "message"))).alias("s"))
    return top.join(first, "template_id", "left").select("template_id", "log_count", F.transform("s", lambda x: x["message"]).alias("sample_messages"), F.lit(0.0).alias("relative_change"))


def relative_change(logs: DataFrame, org_id: str, log_stream_id: str, baseline: tuple[str, str], current: tuple[str, str]) -> DataFrame:
    """An addition: each template's count in two periods and the change as a share of the first."""
    both = in_range(logs, org_id, log_stream_id, baseline[0], current[1])
    at, kind = F.col("timestamp"), logs.schema["timestamp"].dataType
    inside = lambda p: F.count_if((at >= F.lit(p[0]).cast(kind)) & (at <= F.lit(p[1]).cast(kind)))
    counts = both.groupBy(F.coalesce(F.col("template_id").cast("string"), F.lit("")).alias("template_id")).agg(inside(baseline).alias("before"), inside(current).alias("now"))
    return counts.withColumn("relative_change", F.when(F.col("before") > 0, F.round((F.col("now") - F.col("before")) / F.col("before"), 6)))


def kl_divergence(rows: DataFrame, value: str, current) -> DataFrame:
    """An addition: divergence of a value's distribution where ``current`` holds from that where it does not, with one added to each count."""
    counts = rows.groupBy(value).agg((F.count_if(current) + 1).alias("p"), (F.count_if(~current) + 1).alias("q"))
    totals = counts.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    p, q = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return counts.crossJoin(F.broadcast(totals)).agg(F.round(F.sum(p * F.log(p / q)), 6).alias("kl"))


def template_examples(examples: DataFrame, org_id: str, log_stream_id: str, template_id: str, limit: int, tie: str = "line_id") -> DataFrame:
    """Newest examples of a template."""
    return examples.where((F.col("org_id") == org_id) & (F.col("log_stream_id") == log_stream_id) & (F.col("template_id") == template_id)).orderBy(F.desc("timestamp"), tie).limit(limit)


def to_log_rows(matched: DataFrame) -> DataFrame:
    """Matched lines as rows of the log table: milliseconds, '' for no template."""
    return matched.withColumn("template_id", F.coalesce(F.col("template_id").cast("string"), F.lit(""))).withColumn("timestamp", F.date_trunc("MILLISECOND", F.col("timestamp").cast("timestamp"))).select(*LOG_COLUMNS)


def append_logs(rows: DataFrame, path: str) -> None:
    """Partitioned by organisation and day, so that a query for a stream and period reads little. No rows: nothing is written."""
    if rows.isEmpty():
        return
    rows.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("org_id", "day").parquet(path)


def as_json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, times with milliseconds."""
    return rows.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSS", "ignoreNullFields": "false"}).alias("value"))


def append_examples(rows: DataFrame, path: str) -> None:
    """Rows without a template are no examples."""
    rows.where("template_id <> ''").select("org_id", "log_stream_id", "service", "region", "template_id", "message", "timestamp").write.mode("append").parquet(path)


def init_tables(spark: SparkSession, path: str) -> None:
    """Empty tables with fixed schemas."""
    for name, ddl in (("logs", schema.LOGS), ("templates", schema.TEMPLATES), ("template_examples", schema.TEMPLATE_EXAMPLES)):
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{path}/{name}")


def clear_templates(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], schema.TEMPLATES).write.mode("overwrite").parquet(f"{path}/templates")


def write_report(results: DataFrame, path: str, kind: str = "csv") -> None:
    """Benchmark results as CSV with a header, or JSON."""
    out = results.coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)
