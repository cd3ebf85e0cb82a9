import pytest
from pyspark.sql import functions as F

from strandlog.functions import formats, templates, tokens
from strandlog.operators import generate, learn

SSH = "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=218.188.2.4"
KERNEL = "Jun 14 15:16:01 combo kernel: PCI: Using configuration type 1"


def one(spark, text, c):
    return spark.createDataFrame([(text,)], "m string").select(c(F.col("m")).alias("x")).first()["x"]


def test_formats(spark):
    assert one(spark, SSH, formats.detect_format).asDict() == {"format": "syslog", "has_pid": True, "delimiter": None}
    assert one(spark, KERNEL, formats.detect_format)["has_pid"] is False
    assert one(spark, "2024-01-01T10:00:00 x", formats.detect_format)["format"] == "iso_timestamp"
    assert one(spark, "a|b|c|d", formats.detect_format)["delimiter"] == "|"
    assert one(spark, "a,b", formats.detect_format)["format"] == "unstructured"
    assert one(spark, None, formats.detect_format)["format"] == "unstructured"


def test_syslog_fields(spark):
    f = one(spark, SSH, formats.syslog_fields)
    assert (f.timestamp, f.hostname, f.service, f.pid) == ("Jun 14 15:16:01", "combo", "sshd(pam_unix)", "[19939]") and f.message.startswith("authentication failure; logname=")
    f = one(spark, KERNEL, formats.syslog_fields)
    assert f.pid is None and f.message == "PCI: Using configuration type 1"
    assert one(spark, "no", formats.syslog_fields) is None


@pytest.mark.parametrize("token, kind", [
    ("sshd", "static"), ("uid", "static"), ("uid=", "static"), ("result", "static"), ("", "static"), ("19939", "ephemeral"), ("218.188.2.4", "ephemeral"), ("Jun", "ephemeral"), ("15:16:01", "ephemeral"), ("0xff", "ephemeral"),
    ("root", "user"), ("host.example", "location"), ("/var/x", "resource"), ("ERR_1", "action"), ("word", "generic"),
])
def test_classes(spark, token, kind):
    assert one(spark, token, tokens.classify_token) == kind


@pytest.mark.parametrize("token, kind", [("192.168.1.1", "ip_address"), ("example.com", "hostname"), ("12345", "number"), ("/var/log", "path"), ("15:16:01", "time"), ("Jun", "month"), ("x", "value")])
def test_parameter_types(spark, token, kind):
    assert one(spark, token, tokens.infer_parameter_type) == kind


def test_signatures(spark):
    found = lambda m: F.array(*[F.lit(x) for x in ("sshd", "19939", "authentication", "failure", "root", "host.example")])
    assert one(spark, "", lambda m: tokens.log_type_signature(found(m))) == "sshd authentication failure"
    assert one(spark, "", lambda m: tokens.template_signature(found(m))) == "sshd authentication failure <User> <Location>"


def test_tokenizers(spark):
    assert one(spark, "a=1, b.", tokens.tokenize_fragments) == ["a", "1", "b"]
    assert one(spark, "a`b://c", tokens.tokenize_semantic) == ["a", "b", "c"]
    assert one(spark, "ab12 ,;é", tokens.char_class_tokens) == ["ab", "12", " ", ",;é"]


@pytest.mark.parametrize("template, pattern", [("a <*> b", r"a [\s\S]+? b"), ("x.y", r"x\.y"), ("(<*>)", r"\([\s\S]+?\)"), ("<* *", r"<\* *"), ("a<b", "a<b")])
def test_wildcards(spark, template, pattern):
    assert one(spark, template, templates.loghub_regex) == pattern


def test_replies(spark):
    assert one(spark, 'x ["a", "b"] y', templates.parse_classes) == ["a", "b"]
    assert one(spark, "none", templates.parse_classes) is None
    got = one(spark, 'ok {"pattern": "^a$", "variables": ["v"]}', lambda m: templates.parse_template(m, F.lit("line")))
    assert (got.template_id, got.pattern, got.variables, got.example) == (0, "^a$", ["v"], "line")
    assert one(spark, "{}", lambda m: templates.parse_template(m, F.lit("line"))).pattern == "line"
    assert one(spark, "{bad", lambda m: templates.parse_template(m, F.lit("line"))) is None


@pytest.mark.parametrize("message, pattern", [
    ("from 10.0.0.1 port 22", r"from (\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}) port (\d+)"), ("took 1.5 s", r"took (\d+\.\d+) s"), ("took 1.5s", r"took (\d+)\.5s"), ("at /var/log/x.log", r"at ([\w/\.-]+)"), ("", "(.+)"), ("v 0xff #1", r"v (0x[0-9a-fA-F]+) \#(\d+)"),
])
def test_message_pattern(message, pattern):
    assert generate.message_pattern(message) == pattern


def test_smart_template(spark):
    t = one(spark, SSH, generate.smart_template)
    assert r"sshd\(pam_unix\)" in t.pattern and r"\[(\d+)\]" in t.pattern and t.variables[:3] == ["timestamp", "hostname", "pid"]
    assert r"\[(\d+)\]" not in one(spark, KERNEL, generate.smart_template).pattern


def test_classified_pattern():
    assert generate.classified_pattern(["Jun", "sshd", "[", "1", "]", "x.y"], ["timestamp", "service", "static_text", "pid", "static_text", "static_text"]) == (r"([A-Z][a-z]{2})\s+sshd\s+\[(\d+)\]x\.y", ["month", "pid"])


def test_learn(spark):
    rows = [("a", "port 22 from 10.0.0.1"), ("a", "port 2222 from 10.0.0.7"), ("b", "only 10.0.0.1 here"), ("c", "t 1700000000"), ("c", "t 1700000001"), ("d", "x aa-1"), ("d", "x bb-1 y")]
    got = {r["g"]: (r["pattern"], r["variables"]) for r in learn.learn_patterns(spark.createDataFrame(rows, "g string, message string"), "g").collect()}
    assert got["a"] == (r"port (\d+) from 10\.0\.0\.(\d+)", ["number", "number_2"])
    assert got["b"] == (r"only (\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}) here", ["ip_address"])
    assert got["c"] == (r"t (\d{10,})", ["timestamp"])
    assert got["d"] == (r"x (0x[0-9a-fA-F]+|[0-9a-fA-F]+)\-1 y", ["hex_number"])


def test_consensus(spark):
    rows = [(1, 0, "a  b"), (1, 1, "c"), (1, 2, "a b"), (2, 0, "x"), (2, 1, "y")]
    df = spark.createDataFrame(rows, "k int, rank int, pattern string")
    got = {r["k"]: tuple(r)[1:] for r in generate.consensus(df, "k", "majority").collect()}
    assert got == {1: ("a  b", 2, True), 2: ("x", 1, False)}
    assert {r["k"]: r["agreed"] for r in generate.consensus(df, "k", "unanimous").collect()} == {1: False, 2: False}


def test_provider_config():
    two = tuple(generate.ProviderConfig(n, "rules") for n in "ab")
    assert generate.ConsensusConfig().validate().consensus_strategy == "first_success"
    assert generate.ConsensusConfig(two, "majority").validate()
    for bad in (generate.ConsensusConfig(consensus_strategy="unanimous"), generate.ConsensusConfig(two, "min_agreement", 3), generate.ConsensusConfig(())):
        with pytest.raises(ValueError):
            bad.validate()
    assert generate.ConsensusConfig.from_json('{"providers": [{"name": "x", "provider": "rules", "model": "m"}], "consensus_strategy": "first_success"}').providers[0].model == "m"


def test_generators_and_retries(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return ("ok", [])

    assert generate.with_retries(flaky, sleep=lambda s: None) == ("ok", []) and len(calls) == 3
    assert generate.with_retries(lambda: 1 / 0, sleep=lambda s: None) is None
    df = spark.createDataFrame([(1, "from 10.0.0.1")], "k long, message string")
    assert generate.generate(df, [generate.RuleGenerator()], "k").first()["pattern"].startswith("from (")
