"""Template generators: rules for one line, classified fragments, semantic templates, and the adapter for template services."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlog.functions import formats, tokens
from strandlog.functions.templates import VARIABLE_SHAPES, message_variables, normalized_pattern

_SPECIAL = re.compile(r"([\\.+*?()|\[\]{}^$#&\-~])")
_SHAPES = [(re.compile(shape), group) for _, shape, group in VARIABLE_SHAPES]
_SYSLOG_HEAD = r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([\w\.-]+)\s+"


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def message_pattern(message: str) -> str:
    """The escaped message with variable parts as groups. A kind that comes earlier keeps its places; later kinds take what does not overlap them."""
    taken: list[tuple[int, int, str]] = []
    for shape, group in _SHAPES:
        for m in shape.finditer(message):
            if all(m.end() <= a or m.start() >= b for a, b, _ in taken):
                taken.append((m.start(), m.end(), group))
    out, at = [], 0
    for a, b, group in sorted(taken):
        out += [escape(message[at:a]), group]
        at = b
    out.append(escape(message[at:]))
    return "".join(out) or "(.+)"


@F.pandas_udf(T.StringType())
def message_pattern_udf(message: pd.Series) -> pd.Series:
    """Overlaps between kinds need one look at all of them, so this is an Arrow UDF; repeated messages are worked out once a batch."""
    known = {m: message_pattern(m) for m in message.dropna().unique()}
    return message.map(known.get)


def smart_template(line: Column) -> Column:
    """struct(pattern, variables): syslog lines keep their header, all others are patterns of the whole line."""
    fields, fmt = formats.syslog_fields(line), formats.detect_format(line)
    as_syslog = (fmt["format"] == "syslog") & fields.isNotNull()
    body = F.when(as_syslog, fields["message"]).otherwise(line)
    has_pid = as_syslog & fmt["has_pid"]
    service = F.regexp_replace(F.coalesce(fields["service"], F.lit("")), _SPECIAL.pattern, r"\\$1")
    head = F.when(has_pid, F.concat(F.lit(_SYSLOG_HEAD), service, F.lit(r"\[(\d+)\]:\s+"))).when(as_syslog, F.concat(F.lit(_SYSLOG_HEAD), service, F.lit(r":\s+"))).otherwise(F.lit(""))
    strings = lambda *x: F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>")
    first = F.when(has_pid, strings("timestamp", "hostname", "pid")).when(as_syslog, strings("timestamp", "hostname")).otherwise(strings())
    return F.struct(F.concat(head, message_pattern_udf(body)).alias("pattern"), F.concat(first, message_variables(body)).alias("variables"))


# What stands for a fragment of each class, and its variable's name.
CLASS_PATTERNS = {
    "hostname": (r"([\w\.-]+)", "hostname"), "pid": (r"(\d+)", "pid"), "number": (r"(\d+)", "number"), "ip_address": (r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", "ip_address"),
    "path": (r"([\w/\.-]+)", "path"), "hex": ("(0x[0-9a-fA-F]+|[0-9a-fA-F]+)", "hex"), "uuid": ("([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", "uuid"), "url": (r"(https?://[^\s]+)", "url"),
}
TIME_PATTERNS = (("month", "([A-Z][a-z]{2})"), ("time", r"(\d{2}:\d{2}:\d{2})"), ("timestamp_part", r"(\d+)"), ("timestamp", "(.+?)"))


def _class_part(fragment: str, kind: str) -> tuple[str, str | None]:
    if kind == "timestamp":
        which = 0 if re.fullmatch("[A-Za-z]*", fragment) else 1 if ":" in fragment else 2 if re.fullmatch("[0-9]*", fragment) else 3
        name, part = TIME_PATTERNS[which]
        return part, name
    if kind in CLASS_PATTERNS:
        return CLASS_PATTERNS[kind]
    return escape(fragment), None


def classified_pattern(fragments: list[str], kinds: list[str]) -> tuple[str, list[str]]:
    """The pattern of classified fragments, parted by white space except inside brackets, and its variables."""
    out, variables, bracket = [], [], False
    for i, (fragment, kind) in enumerate(zip(fragments, kinds)):
        if fragment in ("[", "]"):
            out.append("\\" + fragment)
            bracket = fragment == "["
            continue
        part, name = _class_part(fragment, kind)
        out.append(part)
        variables += [name] if name else []
        if i < len(fragments) - 1 and not bracket:
            out.append(r"\s+")
    return "".join(out), variables


@F.pandas_udf(T.StructType().add("pattern", "string").add("variables", T.ArrayType(T.StringType())))
def classified_pattern_udf(fragments: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    built = [classified_pattern(list(f), list(k)) if f is not None and k is not None else (None, None) for f, k in zip(fragments, kinds)]
    return pd.DataFrame(built, columns=["pattern", "variables"])


def semantic_template(line: Column) -> Column:
    """struct(description, keywords, parameters, example): keywords and parameter types; the description is constant without a service."""
    found = tokens.tokenize_semantic(line)
    return F.struct(F.lit("Log event").alias("description"), tokens.keywords(found).alias("keywords"), tokens.parameters(found).alias("parameters"), line.alias("example"))


# ---- consensus of several generators


@dataclass(frozen=True)
class ProviderConfig:
    name: str
    provider: str
    model: str = ""
    api_key: str | None = None
    endpoint: str | None = None
    timeout_secs: int = 30


@dataclass(frozen=True)
class ConsensusConfig:
    providers: tuple[ProviderConfig, ...] = (ProviderConfig("rules", "rules"),)
    consensus_strategy: str = "first_success"
    min_agreement: int = 1

    @classmethod
    def from_json(cls, text: str) -> ConsensusConfig:
        raw = json.loads(text)
        return cls(tuple(ProviderConfig(**p) for p in raw["providers"]), raw.get("consensus_strategy", "first_success"), raw.get("min_agreement", 1))

    def validate(self) -> ConsensusConfig:
        n = len(self.providers)
        if not n:
            raise ValueError("no providers")
        if self.consensus_strategy not in ("unanimous", "majority", "min_agreement", "first_success"):
            raise ValueError(f"unknown strategy {self.consensus_strategy!r}")
        if self.consensus_strategy in ("unanimous", "majority") and n < 2:
            raise ValueError(f"{self.consensus_strategy} needs two providers or more")
        if self.consensus_strategy == "min_agreement" and not 1 <= self.min_agreement <= n:
            raise ValueError("min_agreement must lie between 1 and the number of providers")
        return self


def required_votes(strategy: str, n: Column, min_agreement: int = 1) -> Column:
    return {"unanimous": n, "majority": F.floor(n / 2) + 1, "min_agreement": F.lit(min_agreement), "first_success": F.lit(1)}[strategy]


def consensus(candidates: DataFrame, key: str, strategy: str = "majority", min_agreement: int = 1) -> DataFrame:
    """(key, pattern, votes, agreed) from candidates (key, rank, pattern).

    Patterns that differ in white space only vote together. The largest group with enough votes wins, of
    equal ones the one whose first member ranks first; without enough votes the largest group is taken all the same.
    """
    votes = candidates.groupBy(key, normalized_pattern(F.col("pattern")).alias("norm")).agg(F.count("*").alias("votes"), F.min("rank").alias("first_rank"), F.min_by("pattern", "rank").alias("pattern"))
    best = votes.groupBy(key).agg(F.sum("votes").alias("n"), F.max(F.struct("votes", (-F.col("first_rank")).alias("order"), "pattern")).alias("b"))
    return best.select(key, F.col("b.pattern").alias("pattern"), F.col("b.votes").alias("votes"), (F.col("b.votes") >= required_votes(strategy, F.col("n"), min_agreement)).alias("agreed"))


def first_success(candidates: DataFrame, key: str) -> DataFrame:
    """(key, pattern) of the first provider in order whose reply is usable."""
    return candidates.where("pattern is not null").groupBy(key).agg(F.min_by("pattern", "rank").alias("pattern"))


# ---- adapter


class TemplateGenerator(Protocol):
    name: str

    def generate(self, line: str) -> tuple[str, list[str]]:
        """pattern and variables, or an exception."""


class RuleGenerator:
    """Deterministic, needs no service."""

    name = "rules"

    def generate(self, line: str) -> tuple[str, list[str]]:
        dots = line.count(".")
        names = [n for n, yes in (("ip_address", dots == 3), ("decimal_value", re.search(r"\d+\.\d+", line)), ("number", re.search(r"\b\d+\b", line))) if yes]
        return message_pattern(line), names or ["message"]


def with_retries(call: Callable[[], tuple], attempts: int = 3, wait: float = 1.0, sleep=time.sleep) -> tuple | None:
    """The call's result, trying again after doubling waits with up to a tenth added; None when all attempts fail."""
    for i in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001  a service may fail in any way
            if i < attempts - 1:
                pause = wait * 2**i
                sleep(pause + pause * 0.1 * ((i * 7919) % 11) / 10)
    return None


def generate(lines: DataFrame, generators: list[TemplateGenerator], key: str, message: str = "message", attempts: int = 3) -> DataFrame:
    """(key, rank, provider, pattern, variables): each line's candidates from all generators; failures are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, line in zip(batch[key], batch[message]):
                for rank, g in enumerate(generators):
                    got = with_retries(lambda: g.generate(line), attempts)
                    if got is not None:
                        rows.append((k, rank, g.name, got[0], got[1]))
            yield pd.DataFrame(rows, columns=[key, "rank", "provider", "pattern", "variables"])

    kind = dict(lines.dtypes)[key]
    return lines.select(key, message).mapInPandas(run, f"`{key}` {kind}, rank int, provider string, pattern string, variables array<string>")


def template_prompt(line: Column) -> Column:
    """A request for a template of a line, for services that take free text."""
    return F.concat(F.lit("Write a regular expression for this log line. Keep static text as it is; put changing values (times, addresses, numbers, ids, names, paths) into capture groups and avoid catch-all groups.\nLog line: "), line, F.lit('\nReply with one JSON object only: {"pattern": "^...$", "variables": ["..."]}'))


def class_prompt(fragments: Column, line: Column) -> Column:
    numbered = F.transform(fragments, lambda f, i: F.concat(i.cast("string"), F.lit(": "), f))
    return F.concat(F.lit(f"Give each fragment of this log line one of the classes {', '.join(tokens.FRAGMENT_TYPES)}.\nLog line: "), line, F.lit("\nFragments:\n"), F.array_join(numbered, "\n"), F.lit("\nReply with a JSON array of class names in the fragments' order only."))
