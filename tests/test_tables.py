import json

import pytest
from pyspark.sql import functions as F

from strandlog.operators import catalog, evaluate, split, storage
from strandlog.operators.generate import RuleGenerator
from strandlog.operators.matcher import Matcher
from strandlog.plans import schema
from strandlog.sources import readers
from strandlog.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "x.log").write_text("one\ntwo\nthree\n")
    assert [tuple(r) for r in readers.raw_lines(spark, str(tmp_path / "x.log")).orderBy("line_id").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "s.csv").write_text('LineId,Content,EventId\n1,"a, b",E1\n2,c,E2\n')
    assert [tuple(r) for r in readers.structured_csv(spark, str(tmp_path / "s.csv")).orderBy("line_id").collect()] == [(0, "E1"), (1, "E2")]
    (tmp_path / "t.csv").write_text('EventId,EventTemplate\nE1,"a, <*>"\nE2,c.\n')
    t = readers.template_csv(spark, str(tmp_path / "t.csv"))
    assert {r["event_id"]: (r["template"], r["pattern"]) for r in t.collect()} == {"E1": ("a, <*>", r"a, [\s\S]+?"), "E2": ("c.", r"c\.")}
    assert {tuple(r) for r in readers.naive_template_csv(spark, str(tmp_path / "t.csv")).collect()} == {("E1", "a, <*>"), ("E2", "c.")}
    (tmp_path / "p.csv").write_text("h\n" + ",".join(["1", "line", *"cdefghi", "E1", "rest,with,commas"]) + "\nshort,row\n")
    assert [tuple(r) for r in readers.positional_csv(spark, str(tmp_path / "p.csv"), t).collect()] == [(0, "line", "E1", "a, <*>")]
    (tmp_path / "g.csv").write_text('log,event\n"a, b",E1,T1\nc,E2\n')
    assert [tuple(r) for r in readers.generic_csv(spark, str(tmp_path / "g.csv")).orderBy("line_id").collect()] == [(0, "a, b", "E1", "T1"), (1, "c", "E2", None)]
    assert [tuple(r) for r in readers.generic_csv(spark, str(tmp_path / "g.csv"), naive=True).orderBy("line_id").collect()] == [(0, '"a', 'b"', "E1,T1"), (1, "c", "E2", None)]
    (tmp_path / "linux_templates.json").write_text(json.dumps({"next_template_id": 9, "templates": [{"template_id": 4, "pattern": "a (.*)", "variables": ["v"], "example": "a b"}]}))
    assert [(r["dataset"], r["template_id"]) for r in readers.catalogue_json(spark, str(tmp_path / "linux_templates.json")).collect()] == [("linux", 4)]
    assert readers.stream_catalogue(spark, str(tmp_path / "linux_templates.json"), "o").first()["log_stream_id"] == "cache-linux"
    assert catalog.load_json(spark, str(tmp_path / "linux_templates.json")).next_id == 9
    assert readers.dataset_names(["cache/linux_templates.json", "bGL_templates.json", "x.txt"]) == ["BGL", "Linux"]
    assert readers.in_memory(spark).groupBy("event_id").count().orderBy("count").collect()[0]["event_id"] == "ERROR"


def test_split(spark):
    rows = spark.createDataFrame([(i, f"E{i % 3}") for i in range(6)], "line_id long, event_id string")
    s = split.split_stats(split.stratified_split(rows, split.SplitConfig(0.5))).first()
    assert (s.train_size, s.test_size, s.train_templates, s.test_templates) == (3, 3, 3, 3)
    five = rows.where("line_id < 5")
    assert split.random_split(five, split.SplitConfig(0.6)).where("is_train").count() == 3
    alone = spark.createDataFrame([(0, "E")], "line_id long, event_id string")
    assert not split.stratified_split(alone).first()["is_train"]
    with pytest.raises(ValueError):
        split.split_dataset(rows, five)
    assert split.split_dataset(rows, rows).count() == 6


def test_accuracy_empty_and_ties(spark):
    empty = spark.createDataFrame([], "event_id string, template_id long")
    assert evaluate.accuracy_over_all(empty).first()["accuracy"] == 0.0 and evaluate.match_rate(empty).first()["match_rate"] == 0.0
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", None)], "event_id string, template_id long")
    assert tuple(evaluate.accuracy_over_all(rows).first()) == (1, 1, 1, pytest.approx(33.333333))
    assert evaluate.accuracy_over_grouped(rows).first()["accuracy"] == evaluate.accuracy_over_matched(rows).first()["accuracy"] == 50.0


def request(message, **more):
    return json.dumps({"org_id": "o", "log_stream_id": "s", "service": "v", "region": "r", "log_stream_name": "n", "message": message} | more)


BODIES = [request("cpu_usage: 1.0% - x", timestamp="2024-01-05T10:00:00Z"), '{"logs": [%s, %s]}' % (request("disk_io: 5MB/s - y"), request("new thing 7")), "not json", request("new thing 8")]


def test_ingest(spark):
    rows = ingest.ingest_rows(spark.createDataFrame([(b,) for b in BODIES], "value string"), Matcher.seeded(), F.lit("2020-01-01").cast("timestamp"))
    assert sorted((r.template_id, r.message, r.timestamp.year) for r in rows.collect()) == [("", "new thing 7", 2020), ("", "new thing 8", 2020), ("1", "cpu_usage: 1.0% - x", 2024), ("3", "disk_io: 5MB/s - y", 2020)]
    assert tuple(ingest.response(rows).first()) == (4, 2, 0)
    parsed = ingest.parse_requests(spark.createDataFrame([(b,) for b in BODIES], "value string")).withColumn("timestamp", F.lit(None).cast("timestamp"))
    again, m = ingest.match_or_generate(parsed, Matcher.seeded())
    assert again.where("template_id = ''").count() == 0 and len(m.templates) == 4


def test_more_shapes_than_one_round_makes(spark):
    """Every unmatched shape gets a template, however many there are."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    lines = [f"{word(i)}failed" for i in range(ingest.NEW_TEMPLATES + 30)]
    parsed = ingest.parse_requests(spark.createDataFrame([(request(m),) for m in lines], "value string")).withColumn("timestamp", F.lit(None).cast("timestamp"))
    rows, m = ingest.match_or_generate(parsed, Matcher.seeded())
    assert rows.where("template_id = ''").count() == 0 and len(m.templates) == len(Matcher.seeded().templates) + len(lines)


def test_stream_is_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, b in enumerate(BODIES):
        (folder / f"{i}.txt").write_text(b + "\n")
    run = ingest.Ingestion(spark, Matcher.seeded(), str(tmp_path / "out"), [RuleGenerator()])
    q = run.start(ingest.request_stream(spark, str(folder), 2), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None and run.stats["accepted"] == 4 and run.stats["templates_added"] >= 1
    got = storage.read(spark, f"{tmp_path}/out/logs")
    assert sorted(r.message for r in got.collect()) == ["cpu_usage: 1.0% - x", "disk_io: 5MB/s - y", "new thing 7", "new thing 8"]
    assert run.health().first()["status"] == "ok"


def test_sinks(spark, tmp_path):
    storage.init_tables(spark, str(tmp_path))
    assert storage.read(spark, f"{tmp_path}/templates", schema.TEMPLATES).count() == 0
    rows = ingest.ingest_rows(spark.createDataFrame([(b,) for b in BODIES], "value string"), Matcher.seeded(), F.lit("2020-01-01 00:00:00.1239").cast("timestamp"))
    storage.append_logs(rows, f"{tmp_path}/l")
    storage.append_logs(rows.limit(0), f"{tmp_path}/l")
    back = spark.read.parquet(f"{tmp_path}/l")
    assert back.count() == 4
    assert storage.query_logs(back, "o", "s", "2020-01-01", "2030-01-01", tie="message").count() == 4
    grouped = storage.query_logs_grouped(back, "o", "s", "2020-01-01", "2030-01-01", tie="message").collect()
    assert (grouped[0].template_id, grouped[0].log_count, grouped[0].sample_messages) == ("", 2, ["new thing 7", "new thing 8"])
    line = json.loads(storage.as_json_lines(rows.where("message = 'new thing 7'")).first()[0])
    assert line["timestamp"] == "2020-01-01 00:00:00.123" and line["template_id"] == ""
    storage.append_examples(rows, f"{tmp_path}/e")
    assert storage.read(spark, f"{tmp_path}/e", schema.TEMPLATE_EXAMPLES).count() == 2
    storage.clear_templates(spark, str(tmp_path))
    storage.write_report(evaluate.match_rate(rows), f"{tmp_path}/r", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").first()["total"] == "4"


def test_kl(spark):
    rows = spark.createDataFrame([("a", True), ("b", False)], "v string, now boolean")
    assert storage.kl_divergence(rows, "v", F.col("now")).first()["kl"] == pytest.approx(0.231049, abs=1e-6)


def test_positional_join_keeps_every_line(spark):
    from strandlog import queries

    data = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert queries.queries()["positional_join"](spark, data).count() == n == 10_000


def test_truth_of_another_length(spark):
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(5)], "line_id long, log_line string")
    truth = spark.createDataFrame([(i, f"E{i}") for i in range(1, 8)], "line_id long, event_id string")
    from strandlog.operators import evaluate

    assert sorted(map(tuple, evaluate.with_truth(lines, truth).collect())) == [(i, f"line {i}", f"E{i}") for i in range(1, 5)]


def test_throughput_by_dataset(spark):
    from strandlog.operators import evaluate

    runs = spark.createDataFrame([("a", 100, 2.0, 1.0), ("b", 100, 1.0, 0.5), ("c", 10, 0.2, None)], "dataset string, logs long, seconds double, accuracy double")
    got = [(r.dataset, r.throughput, r.latency_us) for r in evaluate.throughput_by_dataset(runs).collect()]
    assert got == [("b", 100.0, 10000.0), ("a", 50.0, 20000.0), ("c", 50.0, 20000.0)]
