import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlog.functions.fragments import extract_fragments, first_regex, fragment_weight, longest_regex, weight_column
from strandlog.operators import catalog, matcher
from strandlog.operators.matcher import Matcher, Template
from strandlog.plans.config import FIRST, STANDARD, MatcherConfig


@pytest.mark.parametrize("pattern, parts", [
    (r"Request ([a-zA-Z0-9_]+) completed in (\d+)ms with status (\d{3})", ["Request ", " completed in ", "ms with status "]),
    (r"cpu_usage: (\d+\.\d+)% - (.*)", ["cpu_usage: ", "% - "]),
    (r"error: connection timeout after (\d+)ms", ["error: connection timeout after ", "ms"]),
    (r"path: /var/log/(\w+)\.log", ["path: /var/log/", ".log"]),
    (r"a \d{1,3} b", ["a d", "1,3", " b"]),
    (r"^x=(\d+)\s*$", ["x=", "s"]),
    (r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([\w\.-]+)\s+kernel:\s+PCI", ["s", "s", "kernel:s", "PCI"]),
    ("", []), ("(((", []), ("a]b", ["a]b"]), ("tail\\", ["tail"]), ("x)y(z", ["xz"]), ("a[b(c]d", ["a", "d"]),
])
def test_fragments(pattern, parts):
    assert extract_fragments(pattern) == parts


def test_minimum_length_counts_bytes():
    assert extract_fragments("é(x)ab", 2) == ["é", "ab"]
    assert extract_fragments("é(x)ab", 3) == []


@pytest.mark.parametrize("fragment, weight", [
    (" uid=", 0.051), (" tty=", 0.17), (" sshd(pam_unix)[", 0.69375), ("]: authentication failure; logname=", 1.0), ("cpu_usage: ", 0.351818), ("% - ", 0.012),
    ("memory_usage: ", 0.455714), ("GB - ", 0.13), ("disk_io: ", 0.281111), ("MB/s - ", 0.171905), ("s", 0.015), ("ms", 0.03), ("error: connection timeout after ", 1.0),
])
def test_weights(spark, fragment, weight):
    assert fragment_weight(fragment) == pytest.approx(weight, abs=1e-6)
    got = spark.createDataFrame([(fragment,)], "f string").select(weight_column(F.col("f"))).first()[0]
    assert got == pytest.approx(fragment_weight(fragment), abs=1e-12)


def longest_hits(fragments, line):
    """Brute force: at each place the longest fragment that begins there."""
    out, i = [], 0
    while i < len(line):
        here = [f for f in fragments if line.startswith(f, i)]
        if here:
            out.append(max(here, key=len))
            i += len(out[-1])
        else:
            i += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab.(|é ", min_size=1, max_size=5), min_size=1, max_size=12, unique=True), st.text("ab.(|é ", max_size=40))
def test_longest_regex_is_leftmost_longest(fragments, line):
    import re
    assert re.findall(longest_regex(fragments), line) == longest_hits(fragments, line)


def test_first_regex_takes_the_earlier_listed():
    import re
    assert re.findall(first_regex(["ab", "abc"]), "abcab") == ["ab", "ab"]


def ids(spark, m, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, message string")
    one = {r["line_id"]: r["template_id"] for r in matcher.match_templates(df, m).collect()}
    by_join = {r["line_id"]: r["template_id"] for r in matcher.match_by_join(df, m, spark).collect()}
    got = [one[i] for i in range(len(lines))]
    assert got == [by_join.get(i) for i in range(len(lines))]
    return got


def test_seed_templates(spark):
    lines = ["cpu_usage: 67.8% - Server load increased", "memory_usage: 2.5GB - Memory consumption stable", "disk_io: 100MB/s - test", "unknown_format: x", "CPU_usage: 67.8%", "cpu_usage: INVALID FORMAT HERE", None, ""]
    assert ids(spark, Matcher.seeded(), lines) == [1, 2, 3, None, None, 1, None, None]


def test_shared_prefixes(spark):
    m = Matcher.seeded()
    for tid, p in ((10, r"error: connection timeout after (\d+)ms"), (11, r"error: invalid user (\w+)"), (12, r"error: file not found: (.*)")):
        m = m.add(Template(tid, p))
    assert ids(spark, m, ["error: connection timeout after 500ms", "error: invalid user bob", "error: file not found: /x", "error: something else entirely"]) == [10, 11, 12, None]


def test_repeats_ties_and_replacement(spark):
    m = Matcher().add(Template(50, r"pair (\d+) and (\d+) and (\d+)")).add(Template(61, "twin (.*)")).add(Template(60, r"twin (\d+)"))
    df = spark.createDataFrame([(0, "pair 1 and 2 and 3"), (1, "twin 5")], "line_id long, message string")
    got = {r["line_id"]: (r["template_id"], round(r["score"], 6)) for r in matcher.match_templates(df, m).collect()}
    assert got == {0: (50, 0.836538), 1: (60, 1.0)}
    m = m.add(Template(60, "other (x)"))
    assert ids(spark, m, ["twin 5", "other 1"]) == [61, 60]


def test_no_fragments_and_no_templates(spark):
    assert ids(spark, Matcher().add(Template(1, "(.*)")), ["x"]) == [None]
    df = spark.createDataFrame([(0, "x")], "line_id long, message string")
    assert matcher.match_templates(df, Matcher()).first()["template_id"] is None


def test_standard_kind(spark):
    m = Matcher(MatcherConfig(STANDARD)).add(Template(1, "ab(x)abcd"))
    df = spark.createDataFrame([("abcd ab",), (None,)], "message string")
    assert [r[0] for r in df.select(matcher.hits(F.col("message"), m)).collect()] == [["ab", "ab"], []]


def test_brute_force_scores(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "al", "bet", "pha", " x", ": ", "uid="]
    m = Matcher()
    for t in range(1, 25):
        m = m.add(Template(t, "(.*)".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(1, 4)))))
    lines = ["".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(300)]

    def best(line):
        found, out = set(longest_hits(m.fragments, line)), []
        for t in m.templates:
            parts = m.fragments_of(t)
            score = sum(fragment_weight(f) for f in found & set(parts)) / sum(map(fragment_weight, parts))
            if found & set(parts):
                out.append((-round(score, 12), t))
        return min(out)[1] if out and -min(out)[0] >= 0.3 else None

    assert ids(spark, m, lines) == [best(x) for x in lines]


def test_config():
    c = MatcherConfig()
    assert (c.min_fragment_length, c.optimal_batch_size, c.fragment_match_threshold) == (1, 10_000, 0.3)
    assert MatcherConfig.streaming().optimal_batch_size == 1_000 and MatcherConfig.bulk_processing().optimal_batch_size == 50_000
    assert c.with_min_fragment_length(0).min_fragment_length == 1 and c.with_fragment_threshold(7).fragment_match_threshold == 1.0
    with pytest.raises(ValueError):
        c.with_match_kind("other")


def test_min_length_drops_short_fragments(spark):
    p = Template(1, r"err: (\d+)")
    assert ids(spark, Matcher().add(p), ["err: 404"]) == [1]
    assert ids(spark, Matcher(MatcherConfig(min_fragment_length=6)).add(p), ["err: 404"]) == [None]


@pytest.mark.parametrize("kind", ["json", "table"])
def test_saved_matchers(spark, tmp_path, kind):
    m = Matcher()
    for i in range(10):
        m = m.add(Template(0, f"Pattern{i} (.*)", ["v"], f"Pattern{i} x"))
    path = str(tmp_path / "m")
    (catalog.save_json if kind == "json" else catalog.save_table)(m, spark, path)
    back = (catalog.load_json if kind == "json" else catalog.load_table)(spark, path)
    assert back.templates == m.templates and back.next_id == m.next_id == 11
    lines = [f"Pattern{i} data" for i in range(10)]
    assert ids(spark, back, lines) == ids(spark, m, lines) == list(range(1, 11))


def test_hit_places(spark):
    m = Matcher().add(Template(1, r"ab(\d)ab(\d)c"))
    df = spark.createDataFrame([(7, "xabab1c")], "line_id long, message string")
    assert [tuple(r) for r in matcher.hit_rows(df, m).orderBy("position").collect()] == [(7, 0, "ab", 1, 3), (7, 1, "ab", 3, 5), (7, 2, "c", 6, 7)]
    assert FIRST != STANDARD
