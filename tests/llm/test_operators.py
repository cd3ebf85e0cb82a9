import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlog.llm import chat, class_lm, decontamination, exact_dedup, jaccard_join, licenses, packing, quality, substring_dedup, token_files, tokens
from strandlog.llm.common import Workspace
from strandlog.llm.components import components


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, k):
    w = low(text).encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


# ---- 1


def linked(rows, k, num, den):
    """Brute force over ids and sets: smallest id of each component."""
    by_id = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by_id[r[0]].append(shingles(r[1], k))
    root = {i: i for i in by_id}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(by_id)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and den * len(a & b) >= num * len(a | b) for a in by_id[i] for b in by_id[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((r[0], len(shingles(r[1], k)), find(r[0]) if r[0] is not None else None) for r in rows), key=repr)


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard(odd, odd_docs, clashing, k, num, den):
    want = linked(odd, k, num, den)
    for docs in (odd_docs, clashing):
        got = jaccard_join.jaccard_components(docs, k, num, den)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_jaccard_hot_group(spark, monkeypatch):
    """A chain of near copies of which many do not link with each other, in small blocks."""
    import random
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        if rng.random() < 0.5:
            words = list(words)
            words[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "FAN", 2)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 5)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == linked(rows, 4, 85, 100)


@pytest.mark.parametrize("held", [4 << 20, 10_000])
def test_jaccard_pairs_of_a_hot_group_are_not_made_rows(spark, monkeypatch, held):
    """Texts a little too far from each other to link, and a few that do: what is verified as rows grows with the group, not with its square."""
    words = [f"w{x}" for x in range(400)]
    rows = []
    for i in range(160):
        for x in range(20, 400, 40):
            words[x] = f"v{i}x{x}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, t.replace("w399", "end")) for i, t in rows[::20]]
    counted, before = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: counted.append(pairs.count()) or before(pairs, *a))
    monkeypatch.setattr(jaccard_join, "HELD", held, raising=False)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 82, 100)
    want = linked(rows, 4, 82, 100)
    assert len({c for _, _, c in want}) == 160
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(counted) < 6 * len(rows)


@pytest.mark.parametrize("apart", [(False, False), (True, False), (False, True)])
def test_forest_joins_what_links_join(apart):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.04, rng.integers(0, 2**63, 60), base).astype(np.uint64)) for _ in range(150)]
    blocks, subs, roots = rng.integers(0, 2, 150), rng.integers(0, 2, 150), np.arange(150) // 2 * 2
    points, sizes = [jaccard_join.point(s) for s in sets], np.array([len(s) for s in sets])
    got = list(jaccard_join._forest(np.arange(150), sizes, roots, blocks, subs, points, sets, apart, 88, 100))

    def joined(edges):
        root = roots.copy()
        for a, b in edges:
            root[root == root[a]] = root[b]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())}

    fits = lambda a, b: not (apart[0] and blocks[a] == blocks[b] or apart[1] and subs[a] == subs[b])
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for a in range(150) for b in range(150) if a != b and fits(a, b) and 100 * both(a, b) >= 88 * (sizes[a] + sizes[b] - both(a, b))}
    assert set(got) <= links and len(got) < 75
    assert joined(got) == joined(links) and 1 < len(joined(links)) < 60


def test_jaccard_empty(no_docs):
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_count_tree_bound():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2000, rng.integers(1, 400)).astype(np.uint64)) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[:-3], rng.integers(0, 2000, 2).astype(np.uint64)])) for s in sets if len(s) > 5]
    sets = [np.unique(s * np.uint64(0x9E3779B97F4A7C15)) for s in sets]
    points = [jaccard_join.point(s) for s in sets]
    found = {tuple(sorted(p)) for x, y, _ in jaccard_join.tree_pairs(np.array([len(s) for s in sets]), np.arange(len(sets)), points, 85, 100) for p in zip(x.tolist(), y.tolist())}
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                assert (j, i) in found
    assert len(found) < 80 * 79 / 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    ws = Workspace(spark, "test")
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), ws, "c").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), ws, "e").count() == 0


def test_one_of_each(odd, clashing, no_docs):
    kept = jaccard_join.one_of_each(clashing, 5, 4, 5)
    assert kept.columns == clashing.columns
    component = {i: c for i, _, c in linked(odd, 5, 4, 5)}
    rows = kept.collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in odd if r[0] is None or component[r[0]] == r[0]), key=repr)
    assert all(r["node"] == r["n"] == r["key"] == "clash" for r in rows)
    assert jaccard_join.one_of_each(no_docs).count() == 0


# ---- 2


@pytest.mark.parametrize("vocabulary", [1_000_000, 10])
def test_class_lm_counts(odd, clashing, vocabulary):
    got = class_lm.score(clashing, head=20, tails=8, classes=4, vocabulary=vocabulary).collect()
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    toks = lambda t: low(t).encode().split() + [None]
    counts = Counter(w for r in odd if not out(r[0]) for w in toks(r[1]))
    n, v = sum(counts.values()), len(counts)

    def base(t):
        return sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks(t))

    want = sorted(((r[0], out(r[0]), len(toks(r[1])), sum(counts[w] > 0 for w in toks(r[1])), n, round(base(r[1]), 5)) for r in odd), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_class_lm_is_a_distribution():
    """Transitions sum to one, and so do the emissions of a class with its unseen words."""
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 5, (11, 11)).astype(float)
    cls = class_lm.exchange(pairs, 3)
    assert cls[-1] == 3 and set(cls[:-1]) <= {0, 1, 2}
    counts = np.array([5, 3, 1, 1, 2])
    m = class_lm.Model(class_lm.Types(np.arange(6), 4), cls, pairs, counts, {0: (12, 5, 2, 1)}, 12, 5)
    assert np.allclose((10**m.transition).sum(1), 1)
    c = np.zeros(5, int)
    assert np.isclose((10 ** m.emission(c, counts)).sum() + 5 * 10 ** m.emission(np.array([0]), np.array([0]))[0], 1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 1, 2], 10)
    pairs = np.zeros((31, 31))
    for a in range(30):
        for b in range(30):
            pairs[a, b] = rng.poisson(40 if truth[b] == (truth[a] + 1) % 3 else 1)
    cls = class_lm.exchange(pairs, 3)
    assert all(len(set(cls[i : i + 10])) == 1 for i in (0, 10, 20)) and len(set(cls[:30])) == 3


def test_class_lm_edges(spark, no_docs):
    assert class_lm.score(no_docs).count() == 0
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    only = class_lm.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens) for r in only] == [(0, 0)] * 2 and all(math.isfinite(r.score) for r in only)


def test_words_beyond_the_head_move_as_exchange_moves_them():
    """Brute force: the likelihood of the whole class bigram table with the word in each class."""
    rng = np.random.default_rng(4)
    k, n = 5, 40
    pairs = rng.poisson(0.6, (n, n)).astype(float)
    pairs[7, 3] = 30
    cls = np.append(np.arange(n - 1) % (k - 1), k - 1)
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    def likelihood(c):
        one = np.eye(k)[c]
        g = one.T @ pairs @ one
        return f(g).sum() - f(g.sum(0)).sum() - f(g.sum(1)).sum()

    one = np.eye(k)[cls]
    a = class_lm.Assigner(one.T @ pairs @ one)
    for w in range(n - 1):
        entries = [(cls[v], pairs[v, w]) for v in range(n) if v != w] + [(k + cls[v], pairs[w, v]) for v in range(n) if v != w] + [(2 * k, pairs[w, w]), (2 * k + 1, pairs[w, w])]
        code, count = np.array([e[0] for e in entries]), np.array([e[1] for e in entries])
        got = int(a.best(np.zeros(len(code), int), code, count, cls[[w]])[0])
        tried = [likelihood(np.where(np.arange(n) == w, c, cls)) for c in range(k - 1)]
        assert np.isclose(tried[got], max(tried))


@pytest.mark.parametrize("vocabulary", [1000, 30])
def test_every_word_has_a_class_by_its_neighbours(spark, vocabulary):
    """Words beyond the head that share their last bytes, but not their neighbours, part; each keeps its count, however few are listed at once."""
    rows = [(i, f"the x{i % 40}ing of a y{i % 40}ing in" * 3) for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, lexicon = class_lm.train(docs, Workspace(spark, "t"), head=4, tails=1, classes=4, vocabulary=vocabulary)
    found = lexicon.collect()
    counts = Counter(w for _, t in rows for w in t.split())
    assert sorted(r["n"] for r in found) == sorted(counts.values())
    least = sorted(counts.values())[-4]
    assert len({r["class"] for r in found if r["n"] <= least}) > 1
    assert len(model.words) <= vocabulary and len({r["word"] for r in found}) == len(found)


def test_class_lm_score_by_brute_force(spark):
    """The score of every row from the model's classes, counts and formula, token by token in Python; few words listed, so most come by the join."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=np.arange(60, 0, -1) / 1830))) for i in range(120)] + [(500, "new words w1 only"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    sizes = dict(head=10, tails=3, classes=4, min_count=3, vocabulary=20)
    got = {r["doc_id"]: r["score"] for r in class_lm.score(docs, **sizes).collect()}
    model, lexicon = class_lm.train(docs.where(~class_lm.held_out(F.col("doc_id"))), Workspace(spark, "t"), **sizes)
    table = {r["word"]: (r["n"], r["class"]) for r in lexicon.collect()}
    k, t = len(model.grid), model.types

    def tokens_of(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, tail, _ = class_lm._tokens(raw, np.array([0, len(raw)]), t.tails)
        return [(table.get(w, (0, int(model.cls[len(t.words) + g]))) if g >= 0 else (sum(not out(i) for i, _ in rows), k - 1)) for w, g in zip(h.tolist(), tail.tolist())]

    coded = {i: tokens_of(x) for i, x in rows}
    grid = np.zeros((k, k))
    seen = defaultdict(set)
    for i, toks in coded.items():
        if not out(i):
            for a, b in zip([k - 1] + [c for _, c in toks], [c for _, c in toks]):
                grid[a, b] += 1
    for w, (n, c) in table.items():
        seen[c].add((w, n))
    unigram = (grid.sum(0) + 0.5) / (grid.sum() + 0.5 * k)

    def emission(n, c):
        members = [m for _, m in seen[c]] if c < k - 1 else [sum(not out(i) for i, _ in rows)]
        ones, twos = members.count(1), members.count(2)
        discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones and c < k - 1 else 0.05 if members else 0.5
        return math.log10((n - discount if n else discount) / max(1, sum(members) + (not members)))

    for i, toks in coded.items():
        want, last = 0.0, k - 1
        for n, c in toks:
            row = grid[last].sum()
            lam = class_lm.MIXTURE if row else 0.0
            want += math.log10(lam * (grid[last, c] / row if row else 0) + (1 - lam) * unigram[c]) + emission(n, c)
            last = c
        assert abs(got[i] - want) < 1e-6


# ---- 3 and 8


LIBRARY = Tokenizer.from_file(tokens.default_path())  # of its own, as loaded from the file


def encoded(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(odd, odd_docs, clashing):
    for docs in (odd_docs, clashing):
        got = packing.pack(docs, 64).withColumn("crc", F.crc32("ids")).collect()
        want = []
        for r in odd:
            ids = encoded(r[1])
            first = (len(ids) - 1) % 64 + 1
            for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 64)], range(first, len(ids) + 1, 64))):
                want.append((r[0], k, a, b - a, crc(ids[a:b])))
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.crc) for r in got), key=repr) == sorted(want, key=repr)
        by_seq = defaultdict(list)
        for r in got:
            by_seq[r.sequence_id].append((r.offset, r.length))
        for items in by_seq.values():
            at = 0
            for start, n in sorted(items):
                assert start == at
                at += n
            assert at <= 64
        from tests.llm.test_text_tools import best_fit
        assert len(by_seq) == best_fit([r.length for r in got], 64)


@pytest.mark.parametrize("tasks", [1, 3])
def test_packing_is_as_good_as_best_fit(spark, tasks):
    """Ranges swept apart and matched by rank, against sequential best-fit decreasing; one task is the same by definition."""
    from tests.llm.test_text_tools import best_fit

    rng = np.random.default_rng(7)
    for lengths in (rng.integers(1, 65, 1500), np.concatenate([np.full(400, 1), rng.integers(20, 40, 200)])):
        runs = [(int(n), packing.PIECE, part, 0, int(c)) for part in range(3) for n, c in Counter(lengths[part::3].tolist()).items()]
        places = packing.place(spark.createDataFrame(runs, packing.RUN), Workspace(spark, "t"), 64, tasks).collect()
        used, bins = defaultdict(int), defaultdict(list)
        for r in places:
            for i in range(r.n):
                used[(r.part, r.length, r.ordinal0 + i)] += 1
                bins[r.bin + i // r.per_bin].append((r.at + i % r.per_bin * r.length, r.length))
        assert used == {(part, n, i): 1 for n, _, part, _, c in runs for i in range(c)}
        for items in bins.values():
            at = 0
            for start, n in sorted(items):
                assert start == at
                at += n
            assert at <= 64
        best = best_fit(lengths.tolist(), 64)
        assert len(bins) == best if tasks == 1 else len(bins) <= 1.02 * best + 1


def test_packing_empty(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_markers_inside_texts_are_the_librarys(spark, tmp_path):
    rows = [(1, "x <|endoftext|> y"), (2, "<|endoftext|>"), (3, "a<|endoftext|> <|endoftext|>\nb"), (4, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, crc(encoded(t))) for i, t in rows]
    assert sorted((r.doc_id, r.ids_crc32) for r in packing.pack(docs).collect()) == want
    token_files.write_tokens(docs, str(tmp_path / "t"))
    assert sorted((r.doc_id, r.ids_crc32) for r in token_files.digest_tokens(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()) == want


def test_token_files(spark, odd, odd_docs, clashing, tmp_path):
    token_files.write_tokens(clashing, str(tmp_path / "c"))
    assert token_files.read_tokens(spark, str(tmp_path / "c")).count() == len(odd)
    token_files.write_tokens(odd_docs, str(tmp_path / "t"))
    files = token_files.read_tokens(spark, str(tmp_path / "t"))
    got = sorted(map(tuple, token_files.digest_tokens(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in odd), key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(((r[0], len(encoded(r[1])), crc(encoded(r[1]))) for r in odd), key=repr)
    picked = files.where("doc_id = 9").select("doc_id", "n_tokens")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,9)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_token_files_layout(spark, odd_docs, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_tokens(odd_docs.coalesce(1), str(tmp_path / "t"))
    meta = pq.ParquetFile(next(p for p in sorted((tmp_path / "t").glob("*.parquet"), key=lambda p: -p.stat().st_size))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e or "DELTA" in e for e in ids.encodings) and columns["doc_id"].has_column_index


def test_token_files_empty(spark, no_docs, tmp_path):
    token_files.write_tokens(no_docs, str(tmp_path / "t"))
    assert token_files.digest_tokens(token_files.read_tokens(spark, str(tmp_path / "t"))).count() == 0


# ---- 4


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact(odd, odd_docs, clashing, no_docs, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    groups = defaultdict(list)
    for r in odd:
        groups[low(r[1])].append(r[0])
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((r[0], keep[low(r[1])], len(groups[low(r[1])]), r[0] == keep[low(r[1])]) for r in odd), key=repr)
    for docs in (odd_docs, clashing):
        got = exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(tuple, got), key=repr) == want
    for docs in (odd_docs, clashing.withColumn("_own0", F.lit("own")).withColumn("__full", F.lit("own"))):
        kept = exact_dedup.drop_copies(docs)
        rows = kept.collect()
        assert kept.columns == docs.columns and len(rows) == sum(w[3] for w in want)
        assert docs is odd_docs or all(r["kept"] == r["keep_id"] == r["group_size"] == "clash" and r["_own0"] == r["__full"] == "own" for r in rows)
    shas = {(r["doc_id"], r["text_sha256"]) for r in exact_dedup.exact_groups(odd_docs).collect()}
    assert shas == {(r[0], hashlib.sha256(low(r[1]).encode()).hexdigest()) for r in odd}
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert exact_dedup.exact_groups(no_docs).count() == 0


# ---- 5 and 9


def test_licenses(spark, odd_docs, clashing, no_docs):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0"), (3, None), (4, "")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.license, r.n_aligned, r.first_word) for r in got) == [("1", "MIT", 5, 0), ("1", "MIT", 5, 0), ("None", "CC-BY-NC-4.0", 5, 0)]
    assert licenses.scan_licenses(no_docs).count() == licenses.scan_licenses(clashing).count() == 0


@pytest.mark.parametrize("block", [1, 2_000_000])
def test_leaks(spark, odd, odd_docs, clashing, no_docs, block):
    texts = [r[1] for r in odd if r[1] and 10 < len(r[1].split()) < 60]
    items = [(0, texts[0]), (1, " ".join(texts[1].split()[3:])), (2, "nowhere to be found in any of these"), (3, ""), (4, None), (5, "two words"), (None, texts[2]), (6, texts[0].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for r in odd:
        have = shingles(r[1], 5)
        for i, t in items:
            need = shingles(t, 5)
            if need and 5 * len(need & have) >= 4 * len(need):
                want.append((r[0], i, len(need & have), len(need)))
    for docs in (odd_docs, clashing):
        assert sorted(map(tuple, decontamination.leaks(docs, bench, block=block).collect()), key=repr) == sorted(want, key=repr)
    clean = decontamination.drop_leaks(clashing, bench, block=block)
    leaking = {w[0] for w in want}
    assert clean.columns == clashing.columns and clean.where("n = 'clash' and node = 'clash'").count() == clean.count()
    assert decontamination.drop_leaks(no_docs, bench).count() == 0
    assert clean.where("doc_id is not null").count() == sum(r[0] is not None and r[0] not in leaking for r in odd)
    assert decontamination.leaks(no_docs, bench).count() == 0
    assert decontamination.leaks(odd_docs, bench.limit(0)).count() == 0


# ---- 6


def without_copies(rows, size):
    owner = {}
    for r in rows:
        w = (r[1] or "").encode().split()
        for i in range(len(w) - size + 1):
            if r[0] is not None:
                key = tuple(w[i : i + size])
                owner[key] = min(owner.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        stay = [True] * len(w)
        for i in range(len(w) - size + 1):
            if r[0] is not None and owner[tuple(w[i : i + size])] < r[0]:
                stay[i : i + size] = [False] * size
        kept = b" ".join(x for x, s in zip(w, stay) if s)
        out.append((r[0], len(w), len(w) - sum(stay), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, gram, batches", [(50, 16, 2), (50, 16, 1), (20, 7, 6)])
def test_substrings(odd, odd_docs, clashing, size, gram, batches):
    for docs in (odd_docs, clashing):
        got = substring_dedup.dedup_substrings(docs, size, gram, batches).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
        assert sorted(map(tuple, got.collect()), key=repr) == without_copies(odd, size)


def test_substrings_empty(no_docs):
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_index_runs(spark, odd_docs, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path))
    for part in (odd_docs.where("doc_id < 50"), odd_docs.where("doc_id >= 50")):
        index.append(substring_dedup.fingerprints(part))
    before = index.read().distinct().count()
    index.compact()
    assert len(index.runs) == 1 and index.read().count() == before
    assert substring_dedup.FingerprintIndex(spark, str(tmp_path), index.runs).read().count() == before


# ---- 7


def test_chat(spark):
    rows = [(1, 0, "system", "be <kind> # \\b"), (1, 1, "user", None), (1, 2, "assistant", "a\\l</turn>\n### x: "), (1, 3, "assistant", ""), (2, 0, "user", "no reply"), (None, 0, "assistant", "é日"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, None, "z"), (3, 2, "odd: role\n#", "w"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, formatted string, examples string").repartition(4)
    got = chat.format_conversations(df)
    read = {r["conv_id"]: r for r in got.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("examples")).alias("loss")).collect()}
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append((-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    assert read.keys() == convs.keys()
    for key, turns in convs.items():
        turns.sort()
        assert [tuple(t) for t in read[key]["turns"]] == [t[1:] for t in turns]
        assert read[key]["loss"] == "".join(t[2] for t in turns if t[1] == "assistant")
    assert {r["conv_id"]: r["loss"] for r in chat.replies(got, "conv_id").collect()} == {k: read[k]["loss"] for k in read}
    examples = chat.expand(got).where("conv_id = 1").orderBy("turn_no").collect()
    assert [e["turn_no"] for e in examples] == [2, 3]
    for e in examples:
        assert read[1]["formatted"].startswith(e["text"]) and e["loss_stop"] == len(e["text"])
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# ---- 10


def test_quality(spark, odd_docs, clashing, no_docs):
    import random
    rng = random.Random(3)
    good = lambda: ". ".join(" ".join(rng.choice(["the", "of", "river", "stone", "light", "walk"]) for _ in range(9)).capitalize() for _ in range(6))
    junk = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "win$$$", "###"]) for _ in range(60))
    rows = [(i, good() if i % 4 else junk()) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 1600, 3)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    right = [r.predicted == int(r.doc_id % 4 > 0) for r in got if r.held_out]
    assert sum(right) >= 0.95 * len(right)
    kept = quality.keep_good(docs.withColumn("score", F.lit("own")).withColumn("held_out", F.lit(7)), labels)
    assert kept.dtypes == [*docs.dtypes, ("score", "string"), ("held_out", "int")] and 1150 <= kept.count() == kept.where("score = 'own' and held_out = 7").count() <= 1300
    ids = {r.doc_id: r.score for r in quality.score_ids(docs, labels).collect()}
    assert all(abs(ids[r.doc_id] - r.score) < 1e-9 for r in got)
    for d in (odd_docs, clashing):
        assert quality.score(d, labels).where("score between 0 and 1").count() == odd_docs.count()
    assert quality.score(no_docs, labels).count() == 0
    assert quality.score(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_steps_over_all_rows_lower_the_risk(spark):
    """The risk over every unlabelled row, by brute force, and the gradient against differences."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (200, quality.FEATURES)), rng.normal(0, 2, (900, quality.FEATURES))
    w = quality.fit(p, u[:100], 0.4, steps=30)
    seen = spark.createDataFrame([(x,) for x in u.astype(np.float32).tolist()], "x array<float>").repartition(3)

    def risk(w):
        z = lambda x: quality._forward(w, x)[2]
        return 0.4 * np.logaddexp(0, -z(p)).mean() + max(0, np.logaddexp(0, z(u)).mean() - 0.4 * np.logaddexp(0, z(p)).mean())

    assert risk(quality.refine(w, p, seen, 0.4, 8)) < risk(w)
    g = quality._sums(w, u, True)
    for k, i in (("a", 5), ("b", 2), ("c", 3), ("d", 0)):
        other, e = {**w, k: w[k].copy()}, 1e-5
        other[k].ravel()[i] += e
        at = 1 + i + {"a": 0, "b": w["a"].size, "c": w["a"].size + w["b"].size, "d": w["a"].size + w["b"].size + w["c"].size}[k]
        assert np.isclose((quality._sums(other, u, True)[0] - g[0]) / e, g[at], rtol=1e-2, atol=1e-2)


def test_nonnegative_risk_ignores_labels_of_the_unlabelled():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (2000, quality.FEATURES)), rng.normal(-1.5, 1, (1000, quality.FEATURES))
    w = quality.fit(p[:1000], np.concatenate([p[1000:], n]), 0.5, steps=200)
    assert (quality.apply_model(w, p) > 0.5).mean() > 0.97 and (quality.apply_model(w, n) < 0.5).mean() > 0.97
