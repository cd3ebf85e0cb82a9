"""Match rates and grouping accuracy of an assignment (event_id, template_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_rate(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count("*").alias("total"), F.count("template_id").alias("matched"), F.coalesce(F.round(100 * F.count("template_id") / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias("match_rate"))


def pair_counts(assigned: DataFrame) -> DataFrame:
    """(event_id, template_id, n): all that accuracy needs, small whatever the number of lines."""
    return assigned.groupBy("event_id", "template_id").agg(F.count("*").alias("n"))


def majorities(counts: DataFrame) -> DataFrame:
    """(event_id, majority): the template with most lines of the event, of equal ones the smallest id."""
    best = F.max_by("template_id", F.struct(F.col("n"), -F.col("template_id")))
    return counts.where("template_id is not null").groupBy("event_id").agg(best.alias("majority"))


def _judged(assigned: DataFrame) -> DataFrame:
    counts = pair_counts(assigned)
    return counts.join(majorities(counts), "event_id", "left")


def _sum_if(condition) -> F.Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _result(judged: DataFrame, denominator) -> DataFrame:
    correct = _sum_if(F.col("template_id") == F.col("majority"))
    unmatched = _sum_if(F.col("template_id").isNull())
    incorrect = _sum_if(F.col("template_id").isNotNull() & ~F.coalesce(F.col("template_id") == F.col("majority"), F.lit(False)))
    rate = F.when(denominator > 0, F.round(100 * correct / denominator, 6)).otherwise(0.0)
    return judged.agg(correct.alias("correct"), incorrect.alias("incorrect"), unmatched.alias("unmatched"), rate.alias("accuracy"))


def accuracy_over_all(assigned: DataFrame) -> DataFrame:
    """Share of all lines that have their event's majority template."""
    return _result(_judged(assigned), F.coalesce(F.sum("n"), F.lit(0)))


def accuracy_over_grouped(assigned: DataFrame) -> DataFrame:
    """Share of the lines of events that have a majority template at all."""
    return _result(_judged(assigned), _sum_if(F.col("majority").isNotNull()))


def accuracy_over_matched(assigned: DataFrame) -> DataFrame:
    """Share of the lines that have any template."""
    return _result(_judged(assigned), _sum_if(F.col("template_id").isNotNull()))


def strict_group_accuracy(assigned: DataFrame) -> DataFrame:
    """An addition: share of lines whose event and template cover exactly the same lines."""
    counts = pair_counts(assigned)
    by_event = counts.groupBy("event_id").agg(F.count("*").alias("templates_of_event"))
    by_template = counts.where("template_id is not null").groupBy("template_id").agg(F.count("*").alias("events_of_template"))
    both = counts.join(by_event, "event_id").join(by_template, "template_id", "left")
    good = (F.col("templates_of_event") == 1) & (F.col("events_of_template") == 1)
    return both.agg(F.round(100 * _sum_if(good) / F.sum("n"), 6).alias("strict_accuracy"))


def distinct_groups(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("event_id").alias("groups"))


def with_truth(lines: DataFrame, truth: DataFrame) -> DataFrame:
    """Line i with truth i; lines and truths beyond the shorter of the two are dropped."""
    return lines.join(truth, "line_id")


def throughput_by_dataset(runs: DataFrame) -> DataFrame:
    """Each (dataset, logs, seconds, accuracy) with its throughput and latency, the fastest first."""
    return runs.select("dataset", "logs", "accuracy", F.round(F.col("logs") / F.col("seconds"), 6).alias("throughput"), F.round(1e6 * F.col("seconds") / F.col("logs"), 6).alias("latency_us")).orderBy(F.desc("throughput"), "dataset")


def throughput_summary(runs: DataFrame) -> DataFrame:
    """One row over (dataset, logs, seconds, accuracy)."""
    return runs.agg(F.sum("logs").alias("total_logs"), F.round(F.sum("seconds"), 6).alias("total_seconds"), F.round(F.sum("logs") / F.sum("seconds"), 6).alias("overall_throughput"),
                    F.round(F.avg(F.col("logs") / F.col("seconds")), 6).alias("avg_throughput"), F.round(F.avg("accuracy"), 6).alias("avg_accuracy"))


def top_groups(assigned: DataFrame, events: int = 10, templates: int = 3) -> DataFrame:
    """The largest events and the share of each one's most frequent templates."""
    counts = pair_counts(assigned)
    sizes = counts.groupBy("event_id").agg(F.sum("n").alias("event_size")).orderBy(F.desc("event_size"), "event_id").limit(events)
    ranked = counts.where("template_id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("n"), "template_id"))).where(F.col("rank") <= templates)
    return sizes.join(ranked, "event_id").select("event_id", "event_size", "rank", "template_id", "n", F.round(100 * F.col("n") / F.col("event_size"), 6).alias("share"))
