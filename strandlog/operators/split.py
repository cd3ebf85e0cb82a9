"""Train and test splits and interleaving, deterministic by hashes of ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SplitConfig:
    train_ratio: float = 0.8
    seed: int = 42
    stratified: bool = True
    min_test_samples: int = 1


def shuffled(seed: int, key: str = "line_id") -> Column:
    """A pseudo-random order that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


#: Hex digits of the hash by which rows are counted before any are ranked: 65,536 ranges.
_DIGITS = 4


def _first_rows(rows: DataFrame, group: list[str], take: Column, seed: int, key: str) -> DataFrame:
    """rows with is_train: in each group the first ``take`` (an expression of its size n) rows in the shuffled order are.

    Rows are counted by group and by the first digits of their hash; only rows of the one range in which a group's cut
    falls are ranked. So no task sorts a group, however large one is.
    """
    names = [F.col(g) for g in group] or [F.lit(0).alias("__all")]
    marked = rows.withColumn("__h", shuffled(seed, key)).withColumn("__r", F.substring("__h", 1, _DIGITS))
    counts = marked.groupBy(*names, "__r").agg(F.count("*").alias("c"))
    keys = group or ["__all"]
    in_order = Window.partitionBy(*keys).orderBy("__r")
    sized = counts.withColumn("n", F.sum("c").over(Window.partitionBy(*keys))).withColumn("before", F.sum("c").over(in_order) - F.col("c")).withColumn("take", take)
    # the first range that is not wholly taken
    cut = F.min(F.when(F.col("before") + F.col("c") > F.col("take"), F.struct(F.col("__r").alias("r"), (F.col("take") - F.col("before")).alias("left"))))
    cuts = sized.groupBy(*keys).agg(cut.alias("__cut"))
    joined = marked.join(cuts, group, "left") if group else marked.crossJoin(F.broadcast(cuts.drop("__all")))  # one row
    open_ = F.coalesce(F.col("__r") == F.col("__cut.r"), F.lit(False))
    clear = joined.where(~open_).withColumn("is_train", F.coalesce(F.col("__r") < F.col("__cut.r"), F.lit(True)))
    rank = F.row_number().over(Window.partitionBy(*group, "__r").orderBy("__h", key))
    ranked = joined.where(open_).withColumn("is_train", rank <= F.col("__cut.left"))
    return clear.unionByName(ranked).drop("__h", "__r", "__cut")


def random_split(rows: DataFrame, config: SplitConfig = SplitConfig(), key: str = "line_id") -> DataFrame:
    """rows with is_train; exactly floor(n * ratio) are."""
    return _first_rows(rows, [], F.floor(F.col("n") * F.lit(config.train_ratio)), config.seed, key)


def stratified_split(rows: DataFrame, config: SplitConfig = SplitConfig(), key: str = "line_id", event: str = "event_id") -> DataFrame:
    """rows with is_train: the ratio within each event, at least min_test_samples in test, one in train where an event has two or more."""
    n = F.col("n")
    ratio = F.floor(n * F.lit(config.train_ratio))
    enough = F.when(n - ratio < config.min_test_samples, F.greatest(n - config.min_test_samples, F.lit(0))).otherwise(ratio)
    return _first_rows(rows, [event], F.greatest(enough, F.least(F.lit(1), n - 1)), config.seed, key)


def check_aligned(logs: DataFrame, truth: DataFrame, key: str = "line_id") -> None:
    """Raises unless logs and labels have the same lines."""
    n, m = logs.count(), truth.count()
    if n != m:
        raise ValueError(f"{n} log lines but {m} labels")
    if logs.join(truth, key, "left_anti").limit(1).count():
        raise ValueError("some log lines have no label")


def split_dataset(logs: DataFrame, truth: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    check_aligned(logs, truth)
    rows = logs.drop("event_id").join(truth.select("line_id", "event_id"), "line_id")
    return stratified_split(rows, config) if config.stratified else random_split(rows, config)


def split_stats(split: DataFrame) -> DataFrame:
    side = lambda cond: F.countDistinct(F.when(cond, F.col("event_id")))
    train, test = F.count_if("is_train"), F.count_if(~F.col("is_train"))
    ratio = lambda x: F.coalesce(F.round(x / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0))
    return split.agg(train.alias("train_size"), test.alias("test_size"), side(F.col("is_train")).alias("train_templates"), side(~F.col("is_train")).alias("test_templates"),
                     F.countDistinct("event_id").alias("total_templates"), ratio(train).alias("train_ratio"), ratio(test).alias("test_ratio"))


def round_robin(rows: DataFrame, source: str, key: str, per_source: int = 500) -> DataFrame:
    """The i-th line of each source in turn, up to per_source of each: rows with turn, from 0. Ranks are found by a top-k per source."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(key)) - 1)
    return ranked.where(F.col("turn") < per_source).orderBy("turn", source)


def hash_sample(rows: DataFrame, key: str, keep: int = 1, of: int = 100) -> DataFrame:
    """keep of every ``of`` rows by a hash of their id: a sampling operator whose choice depends on the row only."""
    digit = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.where(digit % of < keep)
