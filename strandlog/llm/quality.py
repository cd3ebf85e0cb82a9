"""Operator 10: quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1, the unlabelled set is web text of any quality; negatives
are never shown to the learner as such. A small network on 24 character and word statistics of
the whole text minimises the non-negative unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the logistic loss. The class prior pi is estimated as the share of label 1 among the
labelled training rows. Only the labelled rows are a bounded sample, of at most ``sample`` positives,
drawn by the hash of doc_id. A first fit on the driver, with as many unlabelled rows, gives weights to
begin with; ``PASSES`` steps then lower the risk over all unlabelled rows, whose sums of gradients are
made on the executors. Every text is read once for its statistics, which are kept in scratch space.

Inputs of a score are the text only. Defined results: null and empty texts have the statistics
0 and get a score like any other; an empty table gives no rows; without labelled positives all
scores are the prior ``default_prior`` (so they are where no row is labelled, whatever the texts);
repeated rows are scored each; null ids hash as the empty text; of equal hashes in the sample's order
the smaller doc_id comes first, and a doc_id that stands for several texts may bring any of them;
score drops input columns called as its results, keep_good carries all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandlog.llm.common import Workspace, _SPACE, free_names, small_batches, split_words, text_slices, word_hashes

#: Labelled rows, at most, and unlabelled ones of the first fit.
SAMPLE = 10_000
#: Steps over all unlabelled rows.
PASSES = 12
FEATURES = 24


def _class_table() -> np.ndarray:
    """Of each byte: 0 lower, 1 upper, 2 digit, 3 sentence mark, 4 other mark, 5 bar, 6 white space, 7 first byte of a wider character, 8 later byte."""
    kind = np.full(256, 4)
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    for c in b".,;:'\"-?()":
        kind[c] = 3
    kind[ord("|")] = 5
    kind[_SPACE] = 6
    kind[192:256], kind[128:192] = 7, 8
    return kind


_KIND = _class_table()


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """24 statistics of each whole text."""
    n = len(offs) - 1
    out = np.zeros((n, FEATURES))
    size = np.diff(offs)
    if not len(buf):
        return out
    kind = _KIND[buf]
    text_of = np.repeat(np.arange(n), size)
    hist = np.bincount(text_of * 9 + kind, minlength=9 * n).reshape(n, 9)
    chars = np.maximum(1, size - hist[:, 8])
    out[:, :8] = hist[:, :8] / chars[:, None]
    starts, ends, first = split_words(buf, offs)
    count = np.diff(first)
    some = np.maximum(1, count)
    if len(starts):
        length = ends - starts
        h = word_hashes(buf, starts, ends, True)
        of = np.repeat(np.arange(n), count)
        mean = lambda x: np.bincount(of, x, n) / some
        last, lead = kind[ends - 1], kind[starts]
        all_upper = np.add.reduceat((kind == 0).astype(np.int64), starts) == 0
        all_upper &= np.add.reduceat((kind == 1).astype(np.int64), starts) > 1
        out[:, 8] = mean(length) / 10
        out[:, 9] = np.sqrt(np.maximum(0, mean(length.astype(float) ** 2) / 100 - out[:, 8] ** 2))
        out[:, 10] = mean(last == 4)
        out[:, 11] = mean(last == 3)
        out[:, 12] = mean(lead == 1)
        out[:, 13] = mean(all_upper)
        out[:, 14] = mean(length == 1)
        same_text = of[1:] == of[:-1]
        again = (h[1:] == h[:-1]) & same_text
        out[:, 15] = np.bincount(of[1:], again, n) / some
        order = np.lexsort((h, of))
        hs, os_ = h[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])
        distinct = np.bincount(os_, new, n)
        out[:, 16] = distinct / some
        out[:, 17] = np.log1p(distinct) / 10
        run = np.flatnonzero(new)
        reps = np.diff(np.append(run, len(h)))
        out[:, 18] = np.bincount(os_[run], (reps / np.maximum(1, count[os_[run]])) ** 2, n)
        pairs = h[:-1] * np.uint64(31) + h[1:]
        pairs, pair_of = pairs[same_text], of[1:][same_text]
        if len(pairs):
            o = np.lexsort((pairs, pair_of))
            p, q = pairs[o], pair_of[o]
            fresh = np.ones(len(p), bool)
            fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            out[:, 19] = np.bincount(q, fresh, n) / np.maximum(1, count - 1)
    lines = np.bincount(text_of, buf == 10, n) + 1
    out[:, 20] = np.log1p(lines) / 5
    out[:, 21] = np.log1p(count / lines) / 5
    out[:, 22] = np.log1p(count) / 10
    doubled = np.zeros(len(buf), bool)
    doubled[1:] = (buf[1:] == buf[:-1]) & (kind[1:] == 4) & (text_of[1:] == text_of[:-1])
    out[:, 23] = np.bincount(text_of, doubled, n) / chars
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 400, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights that minimise the non-negative unbiased risk (full-batch Adam; a step that makes the bracket negative goes back up it)."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    xp, xu = (positive - mean) / scale, (unlabelled - mean) / scale
    w = {"a": rng.normal(0, 1 / np.sqrt(xp.shape[1]), (xp.shape[1], hidden)), "b": np.zeros(hidden), "c": rng.normal(0, 1 / np.sqrt(hidden), hidden), "d": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        hp, hu = np.tanh(xp @ w["a"] + w["b"]), np.tanh(xu @ w["a"] + w["b"])
        zp, zu = hp @ w["c"] + w["d"], hu @ w["c"] + w["d"]
        bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if bracket >= 0:
            gp, gu = prior * (sigmoid(zp) - 1) - prior * sigmoid(zp), sigmoid(zu)
        else:
            gp, gu = prior * sigmoid(zp), -sigmoid(zu)
        gp, gu = gp / len(zp), gu / len(zu)
        bp, bu = np.outer(gp, w["c"]) * (1 - hp**2), np.outer(gu, w["c"]) * (1 - hu**2)
        grads = {"a": xp.T @ bp + xu.T @ bu + 1e-5 * w["a"], "b": bp.sum(0) + bu.sum(0), "c": hp.T @ gp + hu.T @ gu + 1e-5 * w["c"], "d": np.array([gp.sum() + gu.sum()])}
        for k, g in grads.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "scale": scale}


def apply_model(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = np.tanh((x - w["mean"]) / w["scale"] @ w["a"] + w["b"]) @ w["c"] + w["d"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def _forward(w: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = (x - w["mean"]) / w["scale"]
    h = np.tanh(x @ w["a"] + w["b"])
    return x, h, h @ w["c"] + w["d"]


def _sums(w: dict[str, np.ndarray], x: np.ndarray, up: bool) -> np.ndarray:
    """Of log(1 + exp(z)) (up) or log(1 + exp(-z)) over all rows: the sum, and those of its gradients by a, b, c and d."""
    x, h, z = _forward(w, x)
    sign = 1 if up else -1
    g = sign / (1 + np.exp(-sign * np.clip(z, -40, 40)))
    back = np.outer(g, w["c"]) * (1 - h**2)
    return np.concatenate([[np.logaddexp(0, sign * z).sum()], (x.T @ back).ravel(), back.sum(0), h.T @ g, [g.sum()]])


def refine(w: dict[str, np.ndarray], positive: np.ndarray, seen: DataFrame, prior: float, passes: int) -> dict[str, np.ndarray]:
    """Steps of Adam on the risk over the trusted positives and all rows (x) of seen; the driver gets one sum for each weight."""
    spark, shape = seen.sparkSession, {k: w[k].shape for k in "abcd"}
    m = v = 0.0
    for step in range(1, passes + 1):
        shared = spark.sparkContext.broadcast(w)

        def run(batches, shared=shared):
            total, n = 0.0, 0
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES).astype(float)
                total, n = total + _sums(shared.value, x, True), n + len(x)
            if n:
                both = np.append(total, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["i", "s"])

        rows = seen.select("x").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        shared.unpersist()
        if not rows:
            return w
        u = np.array([r["s"] for r in rows])
        u = u[:-1] / u[-1]
        against, toward = _sums(w, positive, True) / len(positive), _sums(w, positive, False) / len(positive)
        if u[0] - prior * against[0] >= 0:
            g = prior * toward[1:] + u[1:] - prior * against[1:]
        else:  # the bracket is negative: back up it
            g = prior * against[1:] - u[1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, at = dict(w), 0
        for k in "abcd":
            size = int(np.prod(shape[k]))
            w[k] = w[k] - move[at : at + size].reshape(shape[k])
            at += size
    return w


def _learn(docs: DataFrame, labels: DataFrame, sample: int, default_prior: float, passes: int) -> tuple[DataFrame, dict | None, float]:
    """(doc_id, x) of every row, the weights (none without positives), and the prior."""
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "quality")

    def stats(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, FEATURES))
            for i, j, buf, offs in text_slices(batch):
                x[i:j] = features(buf, offs)
            values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])

    seen = ws.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(stats, "doc_id long, x array<float>"), "features")
    learn = ~held_out(F.col("doc_id"))
    trusted = labels.select(F.col("doc_id").cast("long"), "quality").where(learn & F.col("quality").isNotNull())
    share = trusted.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    prior = default_prior if share is None else min(0.98, max(0.02, share))
    by_hash = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = by_hash(trusted.where("quality = 1").select("doc_id").distinct())
    matrix = lambda df: np.array([r["x"] for r in df.select("x").toLocalIterator()], float).reshape(-1, FEATURES)  # noqa: E731  bounded by `sample`
    unlabelled, positive = matrix(by_hash(seen.where(learn))), matrix(seen.join(F.broadcast(chosen), "doc_id").limit(sample))
    if not len(positive) or not len(unlabelled):
        return seen, None, prior
    return seen, refine(fit(positive, unlabelled, prior), positive, seen.where(learn), prior, passes), prior


def score_ids(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, default_prior: float = 0.5, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from the statistics that were kept: texts are read once."""
    seen, w, prior = _learn(docs, labels, sample, default_prior, passes)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, prior) if w is None else apply_model(w, x))], names=["doc_id", "score"])

    scored = seen.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _with_score(docs: DataFrame, labels: DataFrame, name: str, sample: int, default_prior: float, passes: int) -> DataFrame:
    """All columns of docs and the score under a name that docs does not have."""
    _, w, prior = _learn(docs, labels, sample, default_prior, passes)

    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, prior)
            if w is not None:
                for i, j, buf, offs in text_slices(batch):
                    out[i:j] = apply_model(w, features(buf, offs).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, default_prior: float = 0.5, passes: int = PASSES) -> DataFrame:
    """The rows of docs with held_out, score and predicted beside their own columns."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("held_out", "score", "predicted")])
    scored = _with_score(docs, labels, "score", sample, default_prior, passes)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, passes: int = PASSES) -> DataFrame:
    """The rows that the classifier accepts, with all columns of docs."""
    name = free_names(docs, 1)[0]
    return _with_score(docs, labels, name, SAMPLE, 0.5, passes).where(F.col(name) >= threshold).drop(name)
