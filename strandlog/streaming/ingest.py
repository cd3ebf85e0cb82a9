"""Ingestion: JSON requests to matched rows, as a batch or as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlog.functions.tokens import template_signature, tokenize_fragments
from strandlog.operators import storage
from strandlog.operators.generate import RuleGenerator, TemplateGenerator, generate
from strandlog.operators.matcher import Matcher, Template, match_templates
from strandlog.operators.split import hash_sample
from strandlog.plans.schema import INGEST

#: Distinct shapes of unmatched lines that get a template at once; the rest come up in the next round.
NEW_TEMPLATES = 1_000


def parse_requests(requests: DataFrame, body: str = "value") -> DataFrame:
    """Rows of single requests and of {"logs": [...]}; bodies that are neither give none."""
    one = F.from_json(body, INGEST)
    many = F.from_json(body, f"logs array<struct<{', '.join(f.replace(' ', ':', 1) for f in INGEST.split(', '))}>>")["logs"]
    rows = F.coalesce(many, F.when(one["message"].isNotNull(), F.array(one)))
    return requests.select(F.explode(rows).alias("r")).where("r.message is not null").select("r.*")


def parse_time(text: Column, now: Column | None = None) -> Column:
    """An RFC 3339 time, or else now."""
    return F.coalesce(F.try_to_timestamp(text), now if now is not None else F.current_timestamp())


def ingest_rows(requests: DataFrame, matcher: Matcher, now: Column | None = None, body: str = "value") -> DataFrame:
    """Requests as matched rows of the log table."""
    rows = parse_requests(requests, body).withColumn("timestamp", parse_time(F.col("timestamp"), now))
    return storage.to_log_rows(match_templates(rows, matcher))


def response(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("accepted"), F.count_if(F.col("template_id") != "").alias("matched"), F.lit(0).cast("long").alias("failed"))


def unmatched_shapes(rows: DataFrame, limit: int = NEW_TEMPLATES) -> DataFrame:
    """One line for each signature of unmatched lines, the most frequent first."""
    sig = template_signature(tokenize_fragments(F.col("message")))
    shapes = rows.where("template_id = ''").groupBy(sig.alias("signature")).agg(F.count("*").alias("n"), F.min("message").alias("message"))
    return shapes.orderBy(F.desc("n"), "signature").limit(limit)


def grow(rows: DataFrame, matcher: Matcher, generators: list[TemplateGenerator], limit: int = NEW_TEMPLATES) -> Matcher:
    """The matcher with templates for all unmatched shapes of the log rows: rounds of the most frequent shapes, each after matching with what the rounds before made. A shape is tried once."""
    sig = template_signature(tokenize_fragments(F.col("message")))
    tried: list[str] = []
    while True:
        rest = rows.where("template_id = ''")
        if tried:
            known = rows.sparkSession.createDataFrame([(t,) for t in tried], "tried string")
            rest = rest.withColumn("shape", sig).join(known, F.col("shape").eqNullSafe(F.col("tried")), "left_anti").drop("shape")
            rest = storage.to_log_rows(match_templates(rest.drop("template_id"), matcher))
        shapes = unmatched_shapes(rest, limit).collect()  # at most limit
        if not shapes:
            return matcher
        tried += [r["signature"] for r in shapes]
        lines = rows.sparkSession.createDataFrame([(r["signature"], r["message"]) for r in shapes], "signature string, message string")
        made = generate(lines, generators, "signature").where("rank = 0").orderBy("signature").collect()
        matcher = matcher.add_all([Template(0, r["pattern"], list(r["variables"]), "") for r in made])
        if len(shapes) < limit:
            return matcher


def match_or_generate(rows: DataFrame, matcher: Matcher, generators: list[TemplateGenerator] | None = None) -> tuple[DataFrame, Matcher]:
    """A micro-batch: match, make templates for all distinct unmatched shapes, match again with the larger catalogue."""
    matched = storage.to_log_rows(match_templates(rows, matcher))
    matcher = grow(matched, matcher, generators or [RuleGenerator()], NEW_TEMPLATES)
    return storage.to_log_rows(match_templates(rows, matcher)), matcher


@dataclass
class Ingestion:
    """A streaming query from JSON requests to the log table, with templates that grow between micro-batches.

    The matcher is a value of the driver: each micro-batch uses the version that is current when it starts.
    Counts are of what the query wrote; a repeated micro-batch overwrites its own folder, so rows are written once.
    """

    spark: SparkSession
    matcher: Matcher
    path: str
    generators: list[TemplateGenerator] | None = None
    examples: float = 0.01
    stats: dict[str, int] = field(default_factory=lambda: {"batches": 0, "accepted": 0, "matched": 0, "templates_added": 0})

    def write_batch(self, batch: DataFrame, epoch: int) -> None:
        rows = ingest_rows(batch, self.matcher).persist()
        try:
            counts = response(rows).first()
            rows.write.mode("overwrite").parquet(f"{self.path}/logs/epoch={epoch}")
            matched = rows.where("template_id <> ''")
            hash_sample(matched, "message", int(self.examples * 100), 100).select("org_id", "log_stream_id", "service", "region", "template_id", "message", "timestamp").write.mode("overwrite").parquet(f"{self.path}/template_examples/epoch={epoch}")
            if self.generators is not None and counts["matched"] < counts["accepted"]:
                before = len(self.matcher.templates)
                self.matcher = grow(rows, self.matcher, self.generators, NEW_TEMPLATES)
                self.stats["templates_added"] += len(self.matcher.templates) - before
                self.matcher.dataframe(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/catalogue/epoch={epoch}")
            self.stats["batches"] += 1
            self.stats["accepted"] += counts["accepted"]
            self.stats["matched"] += counts["matched"]
        finally:
            rows.unpersist()

    @classmethod
    def resume(cls, spark: SparkSession, path: str, matcher: Matcher, **kw) -> Ingestion:
        """Goes on with the catalogue that the last micro-batch left below path, or with ``matcher`` where there is none: ids in stored log rows keep their templates."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/catalogue")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(folder):
            epochs = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(folder) if "=" in f.getPath().getName()]
            if epochs:
                matcher = Matcher.from_df(spark.read.parquet(f"{path}/catalogue/epoch={max(epochs)}"), matcher.config)
        return cls(spark, matcher, path, **kw)

    def start(self, requests: DataFrame, checkpoint: str, available_now: bool = False, every: str = "5 seconds", wrap: Callable | None = None) -> StreamingQuery:
        writer = requests.writeStream.foreachBatch(wrap(self.write_batch) if wrap else self.write_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()

    def health(self) -> DataFrame:
        return self.spark.createDataFrame([("ok", len(self.matcher.templates), *self.stats.values())], "status string, templates int, batches int, accepted int, matched int, templates_added int")


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Requests from text files of one JSON body a line; the files of a micro-batch are bounded."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(folder)


def windowed_counts(matched: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """An addition: lines for each template and window of event time; late lines are waited for as long as told."""
    return matched.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "template_id").agg(F.count("*").alias("log_count"))
