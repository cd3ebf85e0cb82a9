"""Operator 2: class-based n-gram language model with classes by exchange clustering.

P(text) is the product over its tokens of P(class | previous class) * P(word | class). All
statistics come from all training documents: word counts, counts of adjacent word types, and from
them class transitions and emissions.

Words are named by 64-bit hashes. Words of the training documents get their classes by the exchange
criterion on their own neighbour counts, in two steps. A word's *type* is the word itself for the
``HEAD`` most frequent words and else one of ``TAILS`` groups by its last bytes. Exchange clustering
of the types between ``CLASSES`` classes, on the driver and on the bounded table of adjacent types,
gives the head words their classes and all others a class to begin with. Then each word that occurs
``MIN_COUNT`` times or more, however many such words there are, moves to the class that raises the
likelihood most, by its counts of neighbours of each class: one round of exchange over that
vocabulary, in parallel, so the moves of other such words are not seen. Tasks know the words by a
sorted list of at most ``VOCABULARY`` of them; more are handled in several passes. Only words that
occur less often, of which a neighbour count says little, and words never seen in training have the
class of their group. The class transitions are counted with the classes after that.

Emissions use absolute discounting within the class, the discounted mass shared by as many unseen
words as seen ones; transitions are interpolated with the class frequencies. All words, their counts
and classes are a distributed table. Scoring looks up the most frequent ones, ``VOCABULARY`` at most,
in a list that is broadcast; all others by a join with the table.

Defined results: a null or empty text is one end token; an empty table gives no rows; without
training rows every word is unknown; repeated rows are scored (and counted) each; a null doc_id
hashes as the empty text; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import Workspace, _LOWER, mix, small_batches, split_words, text_slices, word_hashes

HEAD, TAILS, CLASSES, ROUNDS = 2000, 300, 96, 6
#: Occurrences in training from which on a word's own neighbours decide its class.
MIN_COUNT = 5
#: Words that are broadcast together (14 bytes each).
VOCABULARY = 1_000_000
#: Words whose neighbour counts make a row.
BLOCK = 1024
#: Counts up to this have their likelihoods worked out once for all words.
TABLED = 16
#: Weight of the class bigram against the class unigram.
MIXTURE = 0.98
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 2_000_000
END = -0x5DEECE66D1234567


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def _tokens(buf: np.ndarray, offs: np.ndarray, tails: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all tokens (words, and an end after each text), their tail groups (-1: end), and the texts' first tokens."""
    starts, ends, first = split_words(buf, offs)
    h = word_hashes(buf, starts, ends, True).view(np.int64)
    low = np.concatenate([np.zeros(3, np.uint8), _LOWER[buf]]).astype(np.uint64)
    n = ends - starts
    byte = lambda back: np.where(n >= back, low[ends + 3 - back], 0)
    code = byte(1) | byte(2) << np.uint64(8) | byte(3) << np.uint64(16)
    tail = (mix(code + np.uint64(1)) % np.uint64(tails)).astype(np.int64)
    where = first[1:]
    return np.insert(h, where, END), np.insert(tail, where, -1), first + np.arange(len(first))


def word_counts(docs: DataFrame, tails: int = TAILS) -> DataFrame:
    """(word, tail, n) of all tokens of the documents; tasks count before they pass anything on."""
    small_batches(docs.sparkSession)

    def run(batches):
        words, groups, counts, size = [], [], [], 0

        def merged():
            w, t, c = np.concatenate(words), np.concatenate(groups), np.concatenate(counts)
            u, at, inv = np.unique(w, return_index=True, return_inverse=True)
            return u, t[at], np.bincount(inv, c, len(u)).astype(np.int64)

        for batch in batches:
            for _, _, buf, offs in text_slices(batch, "text"):
                h, tail, _ = _tokens(buf, offs, tails)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                words.append(u)
                groups.append(tail[at])
                counts.append(n)
                size += len(u)
                if size > COUNTED:
                    w, t, c = merged()
                    if len(w) > COUNTED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(t.astype(np.int32)), pa.array(c)], names=["word", "tail", "n"])
                        words, groups, counts, size = [], [], [], 0
                    else:
                        words, groups, counts, size = [w], [t], [c], len(w)
        if words:
            w, t, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(t.astype(np.int32)), pa.array(c)], names=["word", "tail", "n"])

    return docs.select("text").mapInArrow(run, "word long, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


class Types:
    """Type numbers: head words by rank, then tail groups, then the end."""

    def __init__(self, head: np.ndarray, tails: int):
        order = np.argsort(head)
        self.words, self.rank, self.tails = head[order], order, tails
        self.n = len(head) + tails + 1

    def of(self, word: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The type of each token, and whether it is a head word."""
        out = np.where(tail < 0, self.n - 1, len(self.words) + tail)
        if not len(self.words):
            return out, np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        is_head = (self.words[at] == word) & (tail >= 0)
        return np.where(is_head, self.rank[at], out), is_head


def type_pairs(docs: DataFrame, types) -> DataFrame:
    """(left, right, n) of adjacent types in all documents; a text begins after an end."""
    small_batches(docs.sparkSession)

    def run(batches):
        t = types.value
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

        def merged():
            code, inv = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(inv, np.concatenate([n for _, n in held]), len(code)).astype(np.int64)

        for batch in batches:
            for _, _, buf, offs in text_slices(batch, "text"):
                h, tail, first = _tokens(buf, offs, t.tails)
                right, _ = t.of(h, tail)
                left = np.empty_like(right)
                left[0], left[1:] = t.n - 1, right[:-1]
                held.append(np.unique(left * t.n + right, return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED:
                    held = [merged()]
                    size = 0
        codes, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array((codes // t.n).astype(np.int32)), pa.array((codes % t.n).astype(np.int32)), pa.array(counts)], names=["left", "right", "n"])

    return docs.select("text").mapInArrow(run, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each type: moves that raise the class bigram likelihood, type by type, until a round moves none. The last type keeps a class of its own."""
    n = len(pairs)
    classes = max(1, min(classes, n - 1))
    cls = np.arange(n) % classes
    order = np.argsort(-pairs.sum(1), kind="stable")
    order = order[order != n - 1]
    cls[order] = np.arange(n - 1) % classes
    cls[n - 1] = classes
    k = classes + 1
    one = np.eye(k)[cls]
    right, left = pairs @ one, pairs.T @ one  # counts of a type before, after each class
    grid = one.T @ right
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            old, own = cls[w], pairs[w, w]
            r, c = right[w].copy(), left[w].copy()
            if not r.sum() and not c.sum():
                continue
            r[old] -= own
            c[old] -= own
            grid[old, :] -= r
            grid[:, old] -= c
            grid[old, old] -= own
            # likelihood gained by adding w to each class: its row, its column, their crossing, and the margins
            rows, cols = grid + r[None, :], grid + c[:, None]
            gain = (f(rows) - f(grid)).sum(1) + (f(cols) - f(grid)).sum(0)
            d = np.diagonal(grid)
            gain += f(d + r + c + own) - f(d + r) - f(d + c) + f(d)
            sr, sc = grid.sum(1) + c, grid.sum(0) + r  # margins of all other words, those beside w included
            gain -= f(sr + r.sum() + own) - f(sr) + f(sc + c.sum() + own) - f(sc)
            gain[k - 1] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            grid[new, :] += r
            grid[:, new] += c
            grid[new, new] += own
            if new != old:
                moved += 1
                cls[w] = new
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w, :]
                left[:, new] += pairs[w, :]
        if not moved:
            break
    return cls


def _found(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each of h in the sorted words, or -1."""
    if not len(words):
        return np.full(len(h), -1)
    u, inverse = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(words, u), len(words) - 1)
    return np.where(words[at] == u, at, -1)[inverse]


def neighbours(docs: DataFrame, shared) -> DataFrame:
    """(block, cells, counts) of the neighbours of a list of words, BLOCK words a row. A cell is a word's place in its block times 2k + 2 and a code: the class before, k + the class after, 2k beside itself with the word before or 2k + 1 after; cells are kept as differences. Tasks count before they pass anything on; rows of a block are several."""
    small_batches(docs.sparkSession)

    def run(batches):
        t, cls, listed = shared.value
        k = int(cls.max()) + 1
        width = 2 * k + 2
        held, size = [], 0

        def merged():
            key, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return key, np.bincount(inverse, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        def rows(key, n):
            block = key // (BLOCK * width)
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            cell = np.diff(key, prepend=0)
            cell[at] = key[at] - block[at] * BLOCK * width
            ends = (np.append(at, len(key)) * 4).astype(np.int32)
            blob = lambda x: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(x.astype(np.uint32))])
            return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), blob(cell), blob(n)], names=["block", "cells", "counts"])

        for batch in batches:
            for _, _, buf, offs in text_slices(batch, "text"):
                h, tail, _ = _tokens(buf, offs, t.tails)
                types, is_head = t.of(h, tail)
                c = cls[types]
                before, after = np.empty_like(c), np.empty_like(c)
                before[0], before[1:] = cls[-1], c[:-1]
                after[-1], after[:-1] = cls[-1], c[1:]
                same = np.append(False, h[1:] == h[:-1])
                far = np.flatnonzero(~is_head & (tail >= 0))
                place = _found(listed, h[far])
                far, place = far[place >= 0], place[place >= 0]
                if not len(far):
                    continue
                left = np.where(same[far], 2 * k, before[far])
                right = np.where(np.append(same[1:], False)[far], 2 * k + 1, k + after[far])
                held.append(np.unique(np.concatenate([place * width + left, place * width + right]), return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > COUNTED // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged())

    return docs.select("text").mapInArrow(run, "block int, cells binary, counts binary")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


class Assigner:
    """The best class of words, given the class bigram counts of all tokens, these words' own ones included."""

    def __init__(self, grid: np.ndarray):
        self.grid, self.k = grid, len(grid)
        # [class of the neighbour before or (from k) after, own class]
        self.cells = np.concatenate([grid, grid.T])
        self.known = _xlogx(self.cells)
        self.tables = np.stack([_xlogx(self.cells + x) - self.known for x in range(TABLED + 1)])
        self.after, self.before = grid.sum(1), grid.sum(0)

    def best(self, word: np.ndarray, code: np.ndarray, n: np.ndarray, old: np.ndarray) -> np.ndarray:
        """The class of each of len(old) words from entries (word, code, n) sorted by word; of equal gains the old class, then the smallest."""
        k, m = self.k, len(old)
        at_old = np.arange(m), old
        own = np.bincount(word[code == 2 * k], n[code == 2 * k], m)
        plain = code < 2 * k
        word, code, n = word[plain], code[plain], n[plain].astype(float)
        side = np.zeros((m, 2 * k))
        np.add.at(side, (word, code), n)
        c, r = side[:, :k], side[:, k:]  # counts of classes before and after
        gain = np.zeros((m, k))
        keys = np.flatnonzero(side)
        word, code = keys // (2 * k), keys % (2 * k)
        n = side[word, code]
        for i in range(0, len(keys), 16384):
            w, b, x = word[i : i + 16384], code[i : i + 16384], n[i : i + 16384]
            few = x <= TABLED
            part = self.tables[np.where(few, x, 0).astype(np.int64), b]
            big = np.flatnonzero(~few)
            part[big] = _xlogx(self.cells[b[big]] + x[big, None]) - self.known[b[big]]
            # out of its old class the word is taken first
            o = old[w]
            part[np.arange(len(w)), o] = 0.0
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[starts]] += np.add.reduceat(part, starts, axis=0)
        # cells of the old class: without the word they are smaller, in every class that it may join
        row, col = self.grid[old] - r, self.grid[:, old].T - c
        row[at_old] -= c[at_old] + own
        col[at_old] = row[at_old]
        was_r, was_c = self.grid[:, old].T, self.grid[old]
        r_old, c_old = r[at_old][:, None], c[at_old][:, None]
        other_r = _xlogx(col + r_old) - _xlogx(col) - _xlogx(was_r + r_old) + _xlogx(was_r)
        other_c = _xlogx(row + c_old) - _xlogx(row) - _xlogx(was_c + c_old) + _xlogx(was_c)
        other_r[at_old] = other_c[at_old] = 0.0
        gain += other_r + other_c
        stay = (_xlogx(row + r) - _xlogx(row)).sum(1) + (_xlogx(col + c) - _xlogx(col)).sum(1)
        gain[at_old] = stay
        d = np.tile(np.diagonal(self.grid), (m, 1))
        d[at_old] = row[at_old]
        o = own[:, None]
        gain += _xlogx(d + r + c + o) - _xlogx(d + r) - _xlogx(d + c) + _xlogx(d)
        total_r, total_c = r.sum(1) + own, c.sum(1) + own
        # margins: the word leaves those of its old class
        sr, sc = np.tile(self.after, (m, 1)), np.tile(self.before, (m, 1))
        sr[at_old] -= total_r
        sc[at_old] -= total_c
        gain -= _xlogx(sr + total_r[:, None]) - _xlogx(sr) + _xlogx(sc + total_c[:, None]) - _xlogx(sc)
        gain[:, k - 1] = -np.inf
        new = gain.argmax(1)
        return np.where(gain[np.arange(m), new] > gain[at_old] + 1e-9, new, old)


def assign(found: DataFrame, shared, tails: np.ndarray, grid: np.ndarray) -> DataFrame:
    """(word, class) of the listed words that neighbours() counted; tails: the list's tail groups."""
    def run(batches):
        t, cls, listed = shared.value
        k, a = int(cls.max()) + 1, Assigner(grid)
        width, at = 2 * k + 2, None
        dense = np.zeros(BLOCK * width, np.int64)

        def flush():
            words = listed[at * BLOCK : (at + 1) * BLOCK]
            old = cls[len(t.words) + tails[at * BLOCK : (at + 1) * BLOCK]]
            cell = np.flatnonzero(dense)
            new = a.best(cell // width, cell % width, dense[cell], old)
            dense[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(new.astype(np.int32))], names=["word", "class"])

        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None and block != at:
                    yield flush()
                at = block
                dense[np.cumsum(np.frombuffer(cells, np.uint32), dtype=np.int64)] += np.frombuffer(counts, np.uint32)  # a row's cells differ
        if at is not None:
            yield flush()

    return found.repartition("block").sortWithinPartitions("block").mapInArrow(run, "word long, class int")


class Model:
    """What scoring broadcasts; its size is bounded by HEAD, TAILS, CLASSES and VOCABULARY."""

    def __init__(self, types: Types, cls: np.ndarray, pairs: np.ndarray, head_counts: np.ndarray, by_class: dict[int, tuple[int, int, int, int]], total: int, distinct: int):
        self.types, self.cls, self.total, self.distinct, self.head_counts = types, cls, total, distinct, head_counts
        k = int(cls.max()) + 1
        one = np.eye(k)[cls]
        self.grid = one.T @ pairs @ one
        self.use(self.grid)
        self.tokens, self.seen, self.discount = np.zeros(k), np.zeros(k), np.full(k, 0.5)
        for c, (n, v, n1, n2) in by_class.items():
            self.tokens[c], self.seen[c] = n, v
            self.discount[c] = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.05

    def use(self, grid: np.ndarray) -> None:
        """Takes the transitions from these class bigram counts."""
        k = len(grid)
        unigram = (grid.sum(0) + 0.5) / (grid.sum() + 0.5 * k)
        rows = grid.sum(1, keepdims=True)
        bigram = np.divide(grid, rows, out=np.zeros_like(grid), where=rows > 0)
        lam = np.where(rows > 0, MIXTURE, 0.0)
        self.transition = np.log10(lam * bigram + (1 - lam) * unigram[None, :])

    def list_words(self, lexicon: DataFrame, most: int) -> None:
        """Takes the most frequent words, at most so many: all above a count, in steps of an eighth of its binary logarithm."""
        step = F.floor(F.log2("n") * 8)
        left, least = most, None
        for r in lexicon.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # at most 512 rows
            left -= r["count"]
            if left < 0:
                break
            least = r["step"]
        got = lexicon.where(step >= least if least is not None else F.lit(False)).toArrow()
        order = np.argsort(got["word"].to_numpy())
        self.words, self.counts, self.classes = got["word"].to_numpy()[order], got["n"].to_numpy()[order], got["class"].to_numpy()[order].astype(np.int16)

    def emission(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | class) of words with count n; of unseen ones as many are assumed as of seen ones."""
        top = np.where(n > 0, n - self.discount[c], self.discount[c])
        return np.log10(top / np.maximum(1, self.tokens[c] + (self.seen[c] == 0)))


def listed_words(counts: DataFrame, types: Types, min_count: int, vocabulary: int):
    """The words beyond the head that occur min_count times or more, and their tail groups, in sorted lists of about ``vocabulary`` words or fewer."""
    spark = counts.sparkSession
    often = counts.where((F.col("tail") >= 0) & (F.col("n") >= min_count))
    head = spark.createDataFrame([(int(w),) for w in types.words], "word long")
    often = often.join(F.broadcast(head), "word", "left_anti")  # at most HEAD rows
    lists = max(1, -(-often.count() // vocabulary))
    for i in range(lists):
        part = often.where(F.pmod(F.xxhash64("word"), F.lit(lists)) == i) if lists > 1 else often
        got = part.select("word", "tail").toArrow()
        order = np.argsort(got["word"].to_numpy())
        yield got["word"].to_numpy()[order], got["tail"].to_numpy()[order]


def train(docs: DataFrame, ws: Workspace, head: int = HEAD, tails: int = TAILS, classes: int = CLASSES, min_count: int = MIN_COUNT, vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model of bounded size, and the table of all words (word, n, class); transitions are those of the types until use()."""
    spark = docs.sparkSession
    counts = ws.write(word_counts(docs, tails), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where("tail >= 0").orderBy(F.desc("n"), "word").limit(head).collect()
    types = Types(np.array([r["word"] for r in top], np.int64), tails)
    shared = spark.sparkContext.broadcast(types)
    found = ws.write(type_pairs(docs, shared), "pairs").toArrow()  # at most (head + tails + 1)^2 rows of 16 bytes
    pairs = np.zeros((types.n, types.n))
    pairs[found["left"].to_numpy(), found["right"].to_numpy()] = found["n"].to_numpy()
    del found
    cls = exchange(pairs, classes)
    one = np.eye(int(cls.max()) + 1)[cls]
    grid = one.T @ pairs @ one
    moved = spark.createDataFrame([(r["word"], int(c)) for r, c in zip(top, cls)], "word long, class int")
    for i, (words, groups) in enumerate(listed_words(counts, types, min_count, vocabulary)):
        listed = spark.sparkContext.broadcast((types, cls, words))
        found = ws.write(neighbours(docs, listed), f"neighbours-{i}")
        moved = moved.union(ws.write(assign(found, listed, groups, grid), f"moved-{i}"))
        ws.drop(f"neighbours-{i}")
    of_group = F.element_at(F.array(*[F.lit(int(c)) for c in cls[len(top) : len(top) + tails]]), F.col("tail") + 1)
    lexicon = ws.write(counts.where("tail >= 0").join(moved, "word", "left").select("word", "n", F.coalesce("class", of_group).alias("class")), "lexicon")
    sums = [F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")]
    by_class = {r["class"]: (r["n"], r["v"], r["n1"], r["n2"]) for r in lexicon.groupBy("class").agg(*sums).collect()}
    ends = counts.where("tail < 0").agg(F.sum("n")).first()[0] or 0
    by_class[int(cls[-1])] = (ends, 1 if ends else 0, 0, 0)
    ws.drop("counts")
    model = Model(types, cls, pairs, np.array([r["n"] for r in top], np.int64), by_class, total, distinct)
    model.list_words(lexicon, vocabulary)
    return model, lexicon


def resolve(docs: DataFrame, shared, lexicon: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, emitted and the classes of all tokens (16-bit numbers) of every row."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, part int, row long, word long, places binary, classes binary, known long, base double, emitted double"

    def run(batches):
        m, part, row0 = shared.value, TaskContext.get().partitionId(), 0
        t = m.types
        ends = m.tokens[m.cls[-1]]
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, offs in text_slices(batch, "text"):
                h, tail, first = _tokens(buf, offs, t.tails)
                place = _found(m.words, h)
                listed, is_end = place >= 0, tail < 0
                c = m.cls[np.where(is_end, t.n - 1, len(t.words) + tail)]
                c[listed] = m.classes[place[listed]]
                of = np.repeat(np.arange(j - i), np.diff(first))
                count = np.zeros(len(h))
                count[listed] = m.counts[place[listed]]
                count[is_end] = ends
                here = listed | is_end
                emitted = np.zeros(len(h))
                emitted[here] = m.emission(c[here], count[here])
                far_at = np.flatnonzero(~here)
                order = np.lexsort((far_at, h[far_at], of[far_at]))
                w, d, places = h[far_at][order], of[far_at][order], (far_at - first[of[far_at]])[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                k, q = j - i, len(at)
                blob = lambda data, ends, size: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(data)])
                own = np.arange(i, j)
                # a text's own row has a name of its own in place of a word, so that such rows spread over all tasks
                name = mix((own + row0).astype(np.uint64) + np.uint64(part) * np.uint64(2**40)).view(np.int64)
                num = lambda a, kind: pa.array(np.concatenate([a, np.zeros(q)]).astype(kind))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.concatenate([own, d[at] + i]))), pa.array(np.full(k + q, part, np.int32)), pa.array(np.concatenate([own, d[at] + i]) + row0), pa.array(np.concatenate([name, w[at]])),
                    pa.concat_arrays([pa.nulls(k, pa.binary()), blob(places.astype(np.int32), np.append(at, len(w)), 4)]), pa.concat_arrays([blob(c.astype(np.int16), first, 2), pa.nulls(q, pa.binary())]),
                    num(np.bincount(of, here & (count > 0), k), np.int64), num(np.bincount(of, np.where(here, np.log10(count + 1), 0), k), float), num(np.bincount(of, emitted, k), float)],
                    names=["doc_id", "part", "row", "word", "places", "classes", "known", "base", "emitted"])
            row0 += batch.num_rows

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    joined = rows.join(lexicon.select("word", F.col("n").alias("c"), F.col("class").alias("to")), "word", "left")
    word = F.struct("places", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("to", F.lit(-1)).alias("to"))
    docs_ = joined.groupBy("doc_id", "part", "row").agg(
        F.max("classes").alias("classes"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("emitted").alias("emitted"), F.collect_list(F.when(F.col("places").isNotNull(), word)).alias("words"))
    docs_ = docs_.select("doc_id", "classes", "known", "base", "emitted", F.col("words.places").alias("places"), F.col("words.c").alias("c"), F.col("words.to").alias("to"))

    def put(batches):
        m = shared.value
        denominator = np.log10(m.total + m.distinct + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            seqs = batch.column(1).to_pylist()
            length = np.array([len(x) // 2 for x in seqs])
            first = np.append(0, np.cumsum(length))
            c = np.frombuffer(b"".join(seqs), np.int16).copy()
            lists = batch.column(5)
            per_doc = np.diff(lists.offsets.to_numpy())
            blobs = lists.flatten().to_pylist()
            doc = np.repeat(np.arange(len(seqs)), per_doc)
            size = np.array([len(x) // 4 for x in blobs], np.int64)
            at = np.frombuffer(b"".join(blobs), np.int32) + np.repeat(first[doc], size)
            n, to = batch.column(6).flatten().to_numpy().astype(float), batch.column(7).flatten().to_numpy()
            all_to = np.repeat(to, size)
            c[at[all_to >= 0]] = all_to[all_to >= 0]
            own = c[at[np.cumsum(size) - size]]  # every word has a place
            more = np.bincount(doc, size * m.emission(own, n), len(seqs))
            num = lambda i: batch.column(i).to_numpy()
            known = num(2) + np.bincount(doc, size * (n > 0), len(seqs)).astype(np.int64)
            base = num(3) + np.bincount(doc, size * np.log10(n + 1), len(seqs)) - length * denominator
            out = pa.Array.from_buffers(pa.binary(), len(seqs), [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(c)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), pa.array(known), pa.array(base), pa.array(num(4) + more), out], names=["doc_id", "n_tokens", "n_known", "base_score", "emitted", "classes"])

    return docs_.mapInArrow(put, "doc_id long, n_tokens long, n_known long, base_score double, emitted double, classes binary")


def _followed(batch: pa.RecordBatch, column: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the class before and the class of every token; a text begins after an end."""
    seqs = batch.column(column).to_pylist()
    length = np.array([len(x) // 2 for x in seqs], np.int64)
    c = np.frombuffer(b"".join(seqs), np.int16).astype(np.int64)
    before = np.empty_like(c)
    before[:1], before[1:] = end, c[:-1]
    return np.repeat(np.arange(len(seqs)), length), before, c


def class_pairs(resolved: DataFrame, k: int) -> np.ndarray:
    """Counts of adjacent classes in all rows."""
    def run(batches):
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            _, before, c = _followed(batch, 0, k - 1)
            total += np.bincount(before * k + c, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    grid = np.zeros(k * k)
    for r in resolved.select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most k * k
        grid[r["pair"]] = r["n"]
    return grid.reshape(k, k)


def score(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, trained on the rows not held out."""
    spark = docs.sparkSession
    ws = Workspace(spark, "class-lm")
    model, lexicon = train(docs.where(~held_out(F.col("doc_id"))), ws, **sizes)
    resolved = ws.write(resolve(docs, spark.sparkContext.broadcast(model), lexicon), "resolved")
    k = len(model.grid)
    model.use(class_pairs(resolved.where(~held_out(F.col("doc_id"))), k))
    transition = model.transition

    def run(batches):
        for batch in batches:
            of, before, c = _followed(batch, 5, k - 1)
            total = batch.column(4).to_numpy() + np.bincount(of, transition[before, c], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = resolved.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")
