"""Template matching as one map-only plan: the fragments of a line are found, and its templates scored by them.

Longest matches go through an automaton in Arrow batches, see ``match_templates``.

A line's hits are the non-overlapping leftmost-longest occurrences of all fragments. A template's
score is the weight of its distinct fragments that were hit over the weight of all its fragments,
repeats included. The best score at or above the threshold wins; of equal scores the smallest id.

The catalogue is bounded and lives on the driver. For the other kinds of matching it goes into the
plan as a constant: a regular expression of the fragments and a hash table of them (buckets by
CRC-32) with the templates that use each and their share of the score. Lines are never shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.functions.fragments import extract_fragments, first_regex, fragment_weight, longest_regex
from strandlog.plans.config import FIRST, LONGEST, STANDARD, MatcherConfig
from strandlog.plans.schema import TEMPLATE

# The three templates that every new matcher knows.
SEEDS = (
    (1, r"cpu_usage: (\d+\.\d+)% - (.*)", ["percentage", "message"], "cpu_usage: 45.2% - Server load normal"),
    (2, r"memory_usage: (\d+\.\d+)GB - (.*)", ["amount", "message"], "memory_usage: 2.5GB - Memory consumption stable"),
    (3, r"disk_io: (\d+)MB/s - (.*)", ["throughput", "message"], "disk_io: 250MB/s - Disk activity moderate"),
)


#: Distinct sets of hits whose best template a worker keeps.
KNOWN_SETS = 100_000


@dataclass
class Template:
    template_id: int
    pattern: str
    variables: list[str] = field(default_factory=list)
    example: str = ""


@dataclass
class Matcher:
    """A catalogue of templates; adding one gives a new version, plans built before keep theirs."""

    config: MatcherConfig = field(default_factory=MatcherConfig)
    templates: dict[int, Template] = field(default_factory=dict)
    next_id: int = 1
    #: fragments in the order they were first seen; replaced templates leave theirs behind.
    fragment_ids: dict[str, int] = field(default_factory=dict)

    @classmethod
    def seeded(cls, config: MatcherConfig | None = None) -> Matcher:
        m = cls(config or MatcherConfig())
        for row in SEEDS:
            m = m.add(Template(*row))
        return m

    @classmethod
    def from_rows(cls, rows, config: MatcherConfig | None = None, next_id: int | None = None) -> Matcher:
        """A catalogue of exactly these templates, in order of their ids: no seeds."""
        m = cls(config or MatcherConfig()).add_all([Template(r["template_id"], r["pattern"], list(r["variables"] or []), r["example"] or "") for r in sorted(rows, key=lambda r: r["template_id"])])
        m.next_id = max(m.next_id, next_id or 0)
        return m

    @classmethod
    def from_df(cls, templates: DataFrame, config: MatcherConfig | None = None) -> Matcher:
        """From a template table, which is bounded: it is read to the driver."""
        return cls.from_rows([r.asDict() for r in templates.select("template_id", "pattern", "variables", "example").toLocalIterator()], config)

    def add(self, template: Template) -> Matcher:
        """With a template more, or another in its place; id 0 asks for the next free id."""
        return self.add_all([template])

    def add_all(self, templates: list[Template]) -> Matcher:
        """As add for one after another; the catalogue is copied once."""
        known, ids, next_id = dict(self.templates), dict(self.fragment_ids), self.next_id
        for t in templates:
            tid = t.template_id or next_id
            known[tid] = Template(tid, t.pattern, list(t.variables), t.example)
            next_id = max(next_id, tid + 1)
            for f in extract_fragments(t.pattern, self.config.min_fragment_length):
                ids.setdefault(f, len(ids))
        return Matcher(self.config, known, next_id, ids)

    def fragments_of(self, template_id: int) -> list[str]:
        return extract_fragments(self.templates[template_id].pattern, self.config.min_fragment_length)

    @property
    def fragments(self) -> list[str]:
        """Fragments of the current templates, in order of first use."""
        used = {f for t in self.templates for f in self.fragments_of(t)}
        return sorted(used, key=self.fragment_ids.__getitem__)

    @property
    def regex(self) -> str:
        return (first_regex if self.config.match_kind == FIRST else longest_regex)(self.fragments)

    def shares(self, weighted: bool = True) -> list[tuple[str, int, float, float]]:
        """(fragment, template, weight, total of the template), one for each distinct fragment of each template."""
        out = []
        for tid in sorted(self.templates):
            parts = self.fragments_of(tid)
            weigh = fragment_weight if weighted else lambda _: 1.0
            total = sum(weigh(f) for f in parts)
            for f in Counter(parts):
                # a repeated fragment needs all its occurrences in the total, and counts once when hit
                out.append((f, tid, weigh(f), total if weighted else float(len(parts))))
        return out

    def dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.template_id, t.pattern, t.variables, t.example) for _, t in sorted(self.templates.items())], TEMPLATE)


def hits(message: Column, matcher: Matcher) -> Column:
    """Fragments found in a line, in order and with repeats."""
    if matcher.config.match_kind == STANDARD:
        return _standard_hits(matcher.fragments)(message)
    found = F.regexp_extract_all(message, F.lit(matcher.regex), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _standard_hits(fragments: list[str]):
    """Occurrences by earliest end, which no expression finds; of those that end together the longest begins first."""
    @F.pandas_udf("array<string>")
    def run(lines: pd.Series) -> pd.Series:
        by_last: dict[str, list[str]] = {}
        for f in sorted(fragments, key=len, reverse=True):
            by_last.setdefault(f[-1], []).append(f)

        def scan(line):
            out, start = [], 0
            for i, c in enumerate(line or ""):
                for f in by_last.get(c, ()):
                    if i + 1 - len(f) >= start and line.startswith(f, i + 1 - len(f)):
                        out.append(f)
                        start = i + 1
                        break
            return out
        return lines.map(scan)

    return run


_ENTRY = "array<struct<t:bigint,w:double,s:double>>"


def _lookup(shares: list[tuple[str, int, float, float]]) -> tuple[Column, int]:
    """A constant hash table: buckets of (fragment, its templates with weight and total)."""
    by_fragment: dict[str, list] = {}
    for f, tid, w, total in shares:
        by_fragment.setdefault(f, []).append({"t": tid, "w": w, "s": total})
    n = 1
    while n < 2 * len(by_fragment):
        n *= 2
    buckets: list[list] = [[] for _ in range(n)]
    for f, entries in by_fragment.items():
        buckets[zlib.crc32(f.encode()) % n].append({"f": f, "e": entries})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<f:string,e:{_ENTRY}>>>"), n


def best_match(found: Column, matcher: Matcher, threshold: float, weighted: bool = True, repeats: bool = False) -> Column:
    """struct(template_id, score) of the best template for the hits, null below the threshold."""
    shares = matcher.shares(weighted)
    if not shares:
        return F.lit(None).cast("struct<template_id:bigint,score:double>")
    table, n = _lookup(shares)
    found = found if repeats else F.array_distinct(found)
    in_bucket = lambda f: F.filter(F.element_at(table, (F.crc32(f) % n + 1).cast("int")), lambda b: b["f"] == f)
    entries = F.array_sort(F.flatten(F.transform(found, lambda f: F.flatten(F.transform(in_bucket(f), lambda b: b["e"])))))
    # entries are sorted by template, so one pass adds up each template and keeps the best
    start = F.struct(F.lit(-1).cast("bigint").alias("t"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("best"), F.lit(0.0).alias("score"))

    def step(acc: Column, e: Column) -> Column:
        total = F.when(acc["t"] == e["t"], acc["sum"]).otherwise(0.0) + e["w"]
        score = total / e["s"]
        # sums of one template only rise, so a tie with another template is a smaller id seen before
        better = score > acc["score"] + 1e-12
        return F.struct(e["t"].alias("t"), total.alias("sum"), F.when(better, e["t"]).otherwise(acc["best"]).alias("best"), F.when(better, score).otherwise(acc["score"]).alias("score"))

    best = F.aggregate(entries, start, step, lambda acc: F.struct(acc["best"].alias("template_id"), acc["score"].alias("score")))
    return F.when((best["score"] >= threshold - 1e-12) & (best["template_id"] >= 0), best)


def _scorer(matcher: Matcher):
    """An Arrow function from lines to (template_id, score): an automaton finds the hits, and each distinct set of hits is scored once by a worker."""
    by_fragment: dict[str, list[tuple[int, float, float]]] = {}
    for f, tid, weight, total in matcher.shares():
        by_fragment.setdefault(f, []).append((tid, weight, total))
    threshold = matcher.config.fragment_match_threshold - 1e-12
    state: dict = {}

    def score(found: frozenset[str]) -> tuple[int | None, float | None]:
        best, most, now, total = None, 0.0, None, 0.0
        for tid, weight, whole in sorted(e for f in found for e in by_fragment[f]):
            total = weight if tid != now else total + weight
            now = tid
            if total / whole > most + 1e-12:
                best, most = tid, total / whole
        return (best, most) if best is not None and most >= threshold else (None, None)

    @F.pandas_udf("template_id long, score double")
    def run(lines: pd.Series) -> pd.DataFrame:
        import ahocorasick

        if not state:
            automaton = ahocorasick.Automaton()
            for f in by_fragment:
                automaton.add_word(f, f)
            automaton.make_automaton()
            state.update(find=automaton.iter_long, known={})
        find, known, out = state["find"], state["known"], []
        for line in lines:
            found = frozenset([f for _, f in find(line)]) if line else frozenset()
            got = known.get(found)
            if got is None:
                if len(known) > KNOWN_SETS:
                    known.clear()
                got = known[found] = score(found)
            out.append(got)
        ids, scores = zip(*out) if out else ((), ())
        return pd.DataFrame({"template_id": pd.array(ids, "Int64"), "score": pd.array(scores, "Float64")})

    return run


def match_templates(logs: DataFrame, matcher: Matcher, message: str = "message") -> DataFrame:
    """logs with template_id (null: no template) and score.

    Longest matches are found by an automaton in Arrow batches: measured on one core, expressions that score each line
    anew take most of the time, while lines have few distinct sets of hits. The other kinds are expressions.
    """
    if matcher.config.match_kind == LONGEST and matcher.shares():
        best = _scorer(matcher)(F.col(message))
    else:
        best = best_match(hits(F.col(message), matcher), matcher, matcher.config.fragment_match_threshold)
    return logs.withColumn("__best", best).withColumn("template_id", F.col("__best.template_id")).withColumn("score", F.col("__best.score")).drop("__best")


def demo_match(logs: DataFrame, matcher: Matcher, message: str = "message") -> DataFrame:
    """The unweighted variant: fragments of two bytes or more, the first listed wins, hits count with repeats, seven tenths are needed."""
    demo = Matcher(MatcherConfig(FIRST, max(2, matcher.config.min_fragment_length)))
    for tid in sorted(matcher.templates):
        demo = demo.add(matcher.templates[tid])
    best = best_match(hits(F.col(message), demo), demo, 0.7, weighted=False, repeats=True)
    return logs.withColumn("__best", best).withColumn("template_id", F.col("__best.template_id")).withColumn("score", F.col("__best.score")).drop("__best")


def hit_rows(logs: DataFrame, matcher: Matcher, key: str = "line_id", message: str = "message") -> DataFrame:
    """(key, position, fragment, start, stop): every hit with its place in characters."""
    found = logs.select(key, F.col(message).alias("__m"), hits(F.col(message), matcher).alias("__h"))
    # each hit begins at or after the end of the one before it, so places follow from a scan of the array
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<fragment:string,start:int,stop:int>>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        at = F.call_function("locate", f, F.col("__m"), acc["at"])
        one = F.struct(f.alias("fragment"), (at - 1).alias("start"), (at - 1 + F.char_length(f)).alias("stop"))
        return F.struct((at + F.char_length(f)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    placed = F.aggregate("__h", start, step, lambda acc: acc["out"])
    return found.select(key, F.posexplode(placed).alias("position", "h")).select(key, "position", "h.fragment", "h.start", "h.stop")


def template_fragments(matcher: Matcher, spark: SparkSession) -> DataFrame:
    """(template_id, ordinal, fragment, weight) of the catalogue."""
    rows = [(t, i, f, fragment_weight(f)) for t in sorted(matcher.templates) for i, f in enumerate(matcher.fragments_of(t))]
    return spark.createDataFrame(rows, "template_id long, ordinal int, fragment string, weight double")


def match_by_join(logs: DataFrame, matcher: Matcher, spark: SparkSession, key: str = "line_id") -> DataFrame:
    """(key, template_id, score) by relational steps, the same results: hits joined with the fragment table, summed, arg-max.

    For catalogues too large for a constant in the plan; the fragment table's size is the catalogue's.
    """
    shares = spark.createDataFrame(matcher.shares(), "fragment string, template_id long, weight double, total double")
    rows = logs.select(key, F.explode(F.array_distinct(hits(F.col("message"), matcher))).alias("fragment"))
    scored = rows.join(shares, "fragment").groupBy(key, "template_id").agg((F.sum("weight") / F.first("total")).alias("score"))
    best = scored.groupBy(key).agg(F.max(F.struct(F.round("score", 12).alias("s"), (-F.col("template_id")).alias("t"))).alias("b"))
    return best.where(F.col("b.s") >= matcher.config.fragment_match_threshold).select(key, (-F.col("b.t")).alias("template_id"), F.col("b.s").alias("score"))
