from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from strandlog.llm import common, licenses, packing, tokens

TEXT = st.text(" \t\n\x0b\x0c\r\x1c\xa0aAbé日.,'#|5", max_size=40)


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_and_hashes(texts):
    got, hashes = [], {}
    for i, j, buf, offs in common.text_slices(batch_of(texts)):
        starts, ends, first = common.split_words(buf, offs)
        h = common.word_hashes(buf, starts, ends, True)
        raw = buf.tobytes()
        for d in range(j - i):
            words = [raw[a:b] for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
            got.append(words)
            for w, x in zip(words, h[first[d] : first[d + 1]]):
                assert hashes.setdefault(w.lower(), x) == x
    assert got == [(t or "").encode().split() for t in texts]
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=4), st.sampled_from([1, 2, 4, 5, 16, 50]))
def test_shingles(docs, k):
    texts = [" ".join(d) for d in docs]
    names = {}
    for i, j, buf, offs in common.text_slices(batch_of(texts)):
        for d, s in enumerate(common.shingle_sets(buf, offs, k)):
            w = docs[i + d]
            want = {tuple(w[x : x + k]) for x in range(max(1, len(w) - k + 1))} if w else set()
            assert len(s) == len(want)
            names.setdefault(frozenset(want), s.tobytes())
            assert names[frozenset(want)] == s.tobytes()
    assert len(set(names.values())) == len(names)


def test_slices_cover_long_texts(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["x" * 35, "", None, "ab cd", "e"] * 3
    seen = [(i, j) for i, j, _, _ in common.text_slices(batch_of(texts))]
    assert [x for i, j in seen for x in range(i, j)] == list(range(len(texts)))


LIBRARY = Tokenizer.from_file(tokens.default_path())
MARKED = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "'s", "été", "日本", "5.", "!", "-,", "ß", "\xa0", "\u3000", "\x1c", "\x85", "<|endoftext|>", "<|endof", "×", "…", "Z."]), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(MARKED, min_size=1, max_size=6))
def test_encoder_equals_the_library(texts):
    """A tokenizer of its own, as loaded from the file, on whole texts."""
    for t, got in zip(texts, tokens.encoder(tokens.default_path()).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_encoder_knows_added_tokens():
    ids = np.frombuffer(tokens.encoder(tokens.default_path()).encode(["x <|endoftext|> y"])[0], "<u4").tolist()
    assert ids == [87, 220, 50256, 331] == LIBRARY.encode("x <|endoftext|> y", add_special_tokens=False).ids


def test_encoder_slices_and_nulls(monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 8)
    texts = [None, "", "one two three", "x", None, " lead", "a\nb"]
    got = tokens.encoder(tokens.default_path()).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_table_is_bounded():
    enc = tokens.Encoder(tokens.default_path(), kept=10)
    for i in range(5):
        enc.encode([" ".join(f"w{i}x{j}" for j in range(20))])
    assert len(enc.places) <= 90


def test_encoder_table_is_bounded_in_bytes(monkeypatch):
    """Few parts, but long ones."""
    monkeypatch.setattr(tokens, "KEPT_BYTES", 100_000, raising=False)
    enc = tokens.Encoder(tokens.default_path())
    for i in range(8):
        text = " ".join(f"{i}x{j}" * 1_000 for j in range(10))
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert sum(map(len, enc.places)) + 4 * len(enc.ids) < 200_000


def best_fit(lengths, capacity):
    """One item after another, longest first: the smallest gap that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def bins_of(placed):
    """Places of single pieces; checks that no sequence is too long and that offsets leave no gap."""
    bins, seen = {}, set()
    for (length, _, part, b, n), first, each, at in placed:
        for r in range(n):
            assert (part, length, b + r) not in seen
            seen.add((part, length, b + r))
            bins.setdefault(first + r // each, []).append((at + r % each * length, length))
    for items in bins.values():
        at = 0
        for start, length in sorted(items):
            assert start == at
            at += length
        assert at <= 32
    return len(bins), len(seen)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(0, 3)), max_size=80))
def test_sweep_is_best_fit(pieces):
    """One sweep over everything, every piece allowed to open a sequence, is sequential best-fit decreasing."""
    made = [0]

    def new(k):
        made[0] += k
        return made[0] - k

    runs = sorted(((n, 1, part, 0, c) for (n, part), c in Counter(pieces).items()), reverse=True)
    out = list(packing.sweep(runs, 32, 0, new))
    assert not [x for x in out if x[0] == packing.LEFT and x[2][1] == packing.PIECE]
    assert bins_of([(run, first, each, at) for what, _, run, first, each, at in out if what == packing.PLACED]) == (best_fit([n for n, _ in pieces], 32), len(pieces))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8))
def test_depths_are_those_of_one_stack(left):
    deep, want = 0, []
    for r in sorted(left):
        pieces, gaps = left[r]
        want.append((r, deep, max(0, deep - pieces)))
        deep = want[-1][2] + gaps
    assert packing.depths(left) == want


def lis(places):
    best = [1] * len(places)
    for i in range(len(places)):
        for j in range(i):
            if places[j] < places[i]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), unique=True, max_size=12))
def test_longest_increasing(places):
    got = [places[i] for i in licenses.increasing(places)]
    assert got == sorted(got) and len(got) == lis(places)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12))
def test_alignment_is_common_and_increasing(a, b):
    found = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@pytest.mark.parametrize("text, want", [
    ("x Released under the MIT License. y", {"MIT"}), ("RELEASED UNDER THE MIT LICENSE", {"MIT"}), ("Released under this MIT License", {"MIT"}), ("under the license", set()), (None, set()), ("", set()),
    ("Licensed under CC BY-NC 4.0. " * 3, {"CC-BY-NC-4.0"}), ("w " * 5000 + "This work is licensed under the GNU General Public License, version 3. " + "w " * 5000, {"GPL-3.0"}),
])
def test_scan(text, want):
    assert {name for name, *_ in licenses.Scanner(licenses.TEMPLATES, 4, 5).scan(text)} == want


@pytest.mark.parametrize("at", range(10))
def test_a_notice_is_found_wherever_it_stands(at):
    text = "w " * at + "Released under the terms and conditions of the MIT License" + " w" * 10
    assert list(licenses.Scanner(licenses.TEMPLATES, 4, 5).scan(text)) == [("MIT", 5, 5, at)]


@pytest.mark.parametrize("at", [0, 5, 11, 20])
def test_interleaved_words_are_aligned_over_the_whole_text(at):
    notice = licenses.TEMPLATES["BSD-3-Clause"].split()
    text = "w " * at + " x y ".join(notice) + " z" * 30
    assert list(licenses.Scanner(licenses.TEMPLATES, 4, 5).scan(text)) == [("BSD-3-Clause", 21, 21, at)]


def test_scan_equals_the_best_alignment():
    """Brute force: the whole text and every window of twice the template's length; of equal coverage the first place."""
    import random
    rng = random.Random(3)
    s = licenses.Scanner({"t": "a b c d e", "u": "c a b", "v": "a b a c a d"}, 4, 5)
    for _ in range(1000):
        w = [rng.choice("abcdexyz").encode() for _ in range(rng.randint(0, 40))]
        want = set()
        for name, t in s.templates.items():
            found = [(-len(f), i + f[0][0]) for i, part in [(0, w), *((i, w[i : i + 2 * len(t)]) for i in range(len(w)))] if (f := licenses.align(part, t))]
            k, first = min(found, default=(0, 0))
            if -k >= s.need[name]:
                want.add((name, -k, len(t), first))
        assert set(s.scan(b" ".join(w).decode())) == want
