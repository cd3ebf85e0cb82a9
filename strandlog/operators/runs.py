"""Benchmark runs: timed matching of datasets, and match-or-generate over a labelled one."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.operators import evaluate
from strandlog.operators.generate import TemplateGenerator
from strandlog.operators.matcher import Matcher, match_templates
from strandlog.plans.schema import BENCHMARK_ROW
from strandlog.streaming.ingest import match_or_generate


def timed(df: DataFrame) -> float:
    """Seconds that all rows take, written nowhere."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def throughput_run(spark: SparkSession, datasets: dict[str, DataFrame], matcher: Matcher) -> DataFrame:
    """One row for each dataset: counts, match rate, lines a second, and accuracy where the dataset has event_id. Datasets are few."""
    rows = []
    for name, logs in sorted(datasets.items()):
        matched = match_templates(logs, matcher)
        seconds = timed(matched)
        rate = evaluate.match_rate(matched).first()
        accuracy = evaluate.accuracy_over_grouped(matched).first()["accuracy"] if "event_id" in logs.columns else 0.0
        total = rate["total"]
        rows.append((name, len(matcher.templates), total, rate["matched"], float(rate["match_rate"]), total / seconds if seconds else 0.0, seconds * 1e6 / total if total else 0.0, float(accuracy)))
    return spark.createDataFrame(rows, BENCHMARK_ROW)


def online_run(logs: DataFrame, matcher: Matcher, generators: list[TemplateGenerator]) -> tuple[DataFrame, Matcher]:
    """Match, generate for what did not match, match again; the accuracy of the outcome over all lines, and the grown catalogue."""
    needed = [c for c in ("org_id", "log_stream_id", "service", "region", "log_stream_name") if c not in logs.columns]
    rows = logs.withColumns({c: F.lit("") for c in needed}) if needed else logs
    if "timestamp" not in rows.columns:
        rows = rows.withColumn("timestamp", F.lit(None).cast("timestamp"))
    _, grown = match_or_generate(rows, matcher, generators)
    return evaluate.accuracy_over_all(match_templates(logs, grown)), grown
