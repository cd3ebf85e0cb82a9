"""Template patterns as literal fragments: extraction, weights, and one regular expression for all of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide scores and must stay as they are.
GENERIC_PATTERNS = (
    " uid=", " gid=", " pid=", " euid=", " egid=", " tty=", " user=", " host=", " ip=", " port=",
    "id=", "name=", "type=", "status=", "code=", ": ", " - ", " | ", " / ",
)
DISTINCTIVE = (
    "sshd", "systemd", "kernel", "docker", "nginx", "apache",
    "authentication", "failure", "error", "warning", "critical", "denied",
    "pam_unix", "logname", "session opened", "session closed",
)
GENERIC_FACTOR, DISTINCTIVE_FACTOR, THRESHOLD = 0.3, 1.5, 0.3

_LEX = re.compile(r"\\(?P<escaped>.)|(?P<open>\()|(?P<close>\))|(?P<set>\[)|(?P<end>\])|(?P<meta>[.*+?{}^$|])|(?P<tail>\\)|(?P<plain>.)", re.S)


def extract_fragments(pattern: str, min_length: int = 1) -> list[str]:
    """Literal parts of a pattern outside groups and character classes, in order and with repeats.

    An escape outside them stands for its character, whatever it means to a regex engine. Metacharacters end
    a fragment. Groups nest; inside a group classes are not looked at. Length is in UTF-8 bytes.
    """
    runs: list[list[str]] = [[]]
    level, in_class = 0, False
    for token in _LEX.finditer(pattern):
        kind, text = token.lastgroup, token.group(token.lastgroup)
        outside = level == 0 and not in_class
        if kind == "open" and not in_class:
            level += 1
            if level == 1:
                runs.append([])
        elif kind == "close" and not in_class:
            level -= 1
        elif kind == "set" and outside:
            in_class = True
            runs.append([])
        elif kind == "end" and in_class:
            in_class = False
        elif kind == "meta" and outside:
            runs.append([])
        elif kind != "tail" and outside:
            runs[-1].append(text)
    joined = ("".join(r) for r in runs)
    return [f for f in joined if f and len(f.encode()) >= min_length]


def is_generic(fragment: str) -> bool:
    core = fragment.strip()
    size = len(core.encode())
    return size < 4 or any(core == p or (size < 8 and p in core) for p in GENERIC_PATTERNS)


def is_distinctive(fragment: str) -> bool:
    low = fragment.lower()
    return any(word in low for word in DISTINCTIVE)


def fragment_weight(fragment: str) -> float:
    """Between 0 and 1: longer, wordier and more telling fragments weigh more."""
    size = len(fragment.encode())
    if not size:
        return 0.0
    if size < 5:
        length = size / 20
    elif size < 20:
        length = 0.25 + (size - 5) / 15 * 0.5
    else:
        length = 0.75 + min((size - 20) / 40, 0.25)
    content = 0.2 + 0.8 * (sum(c.isalnum() for c in fragment) / size)
    weight = length * content
    if is_generic(fragment):
        weight *= GENERIC_FACTOR
    if is_distinctive(fragment):
        weight *= DISTINCTIVE_FACTOR
    return min(1.0, max(0.0, weight))


def weight_column(fragment: Column) -> Column:
    """``fragment_weight`` as an expression."""
    size = F.octet_length(fragment).cast("double")
    length = F.when(size < 5, size / 20).when(size < 20, 0.25 + (size - 5) / 15 * 0.5).otherwise(0.75 + F.least((size - 20) / 40, F.lit(0.25)))
    content = 0.2 + 0.8 * (F.regexp_count(fragment, F.lit(r"[\p{L}\p{N}]")) / size)
    core, low = F.trim(fragment), F.lower(fragment)
    core_size = F.octet_length(core)
    generic = core_size < 4
    for p in GENERIC_PATTERNS:
        generic = generic | (core == p) | ((core_size < 8) & core.contains(p))
    distinctive = F.lit(False)
    for word in DISTINCTIVE:
        distinctive = distinctive | low.contains(word)
    weight = length * content * F.when(generic, GENERIC_FACTOR).otherwise(1.0) * F.when(distinctive, DISTINCTIVE_FACTOR).otherwise(1.0)
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))).otherwise(0.0)


def quote(text: str) -> str:
    """Escaped for Java, RE2 and Python alike."""
    return re.sub(r"([\\.+*?()\[\]{}^$|])", r"\\\1", text)


def longest_regex(fragments: list[str]) -> str:
    """A trie-shaped expression whose leftmost match is the longest of the fragments that begin there."""
    trie: dict = {}
    for f in fragments:
        node = trie
        for c in f:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        # a chain of single children needs no recursion
        chain = []
        while len(node) == 1 and "" not in node:
            c, node = next(iter(node.items()))
            chain.append(quote(c))
        branches = [quote(c) + render(child) for c, child in sorted(node.items()) if c]
        if not branches:
            return "".join(chain)
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return "".join(chain) + (f"(?:{body})?" if "" in node else body)

    return render(trie) if trie else r"[^\s\S]"


def first_regex(fragments: list[str]) -> str:
    """An alternation in the given order: of the fragments that begin at a place, the earliest listed matches."""
    return "|".join(quote(f) for f in fragments) if fragments else r"[^\s\S]"
