"""Operator 3: bulk-synchronous best-fit packing of documents into fixed-length sequences.

A document's ids (with an end id) are cut only if longer than a sequence, from the end, so that
only the first piece is shorter. Pieces of equal length in one input partition are a *run*, bins of
equal gap that were opened together are a run of gaps; both are rows of distributed tables, and
everything below handles runs. A superstep is

1. Runs of pieces and of gaps are range-sorted together by size, the largest first, and every task
   sweeps its range: a piece goes to its successor, the smallest gap that holds it, which is the
   last one met (gaps wait on a stack); gaps are updated at once and serve again within the range.
2. What a range leaves over is first some pieces without a gap, then some gaps. From these two
   numbers of each range the driver finds how deep the stack of all larger gaps is before every
   range; a left-over piece takes the gap of its rank in that stack. Both are dealt by rank, and
   each task matches its ranks, so pieces that compete for the same gap are told apart by rank.
3. Gaps left and pieces left are the next superstep's tables. When hardly a piece found a gap, the
   pieces over half the largest length left open sequences in the next sweep, as best fit
   decreasing does; the first superstep opens them for all pieces over half the capacity.

When few runs are left (``TAIL``), one task sweeps them all, which ends the packing. With one task
from the start the result is that of sequential best-fit decreasing; with more, smaller pieces may
take gaps before larger ones of another range have come down to them, and the number of sequences
can differ from it slightly. The driver holds two numbers for each task only.

Defined results: null and empty texts are one piece with the end id; an empty table gives no rows;
repeated rows are packed as often as they stand there; null ids are kept; which of several equally
long pieces gets which place follows the input's partitions; of further input columns none is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm import tokens
from strandlog.llm.common import Workspace, parts_of, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, ordinal long"
#: A run; kind 0: n bins from number a on with this gap; kind 1: n pieces of this length, of partition a, from ordinal b on.
RUN = "size long, kind int, a long, b long, n long"
#: Rows of a sweep: what 0 is a run left over, at place rank among its range's ones; 1 a gap below the range; 2 n pieces placed from bin on, per_bin in each.
SWEPT = f"what int, range int, rank long, {RUN}, bin long, per_bin long, at long"
GAP, PIECE = 0, 1
LEFT, BELOW, PLACED = 0, 1, 2
#: Runs that one task may end the packing with, and runs that a task of a sweep gets at least.
TAIL, RUNS_A_TASK = 2_000, 4_000
MAX_STEPS = 400
#: Bytes of rows that are encoded together; the batch of ids that the JVM takes over is about as large.
GATHERED = 1 << 21
#: Bytes of a worker's table of encoded parts: workers also hold what the stages before have left.
KEPT_BYTES = 40 << 20


def cut_pieces(docs: DataFrame, capacity: int, path: str, end_id: int) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32 bit) and their ordinal among those of equal length in the partition."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc, part, seen = tokens.encoder(path, KEPT_BYTES), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in tokens.gathered(batches, GATHERED):
            ids, first = enc.encode_ended(batch.column(1), end_id)
            n = np.diff(first)
            pieces = (n - 1) // capacity + 1
            head = n - (pieces - 1) * capacity
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            order = np.argsort(length, kind="stable")
            counts = np.bincount(length, minlength=capacity + 1)
            ordinal = np.empty(len(row), np.int64)
            ordinal[order] = np.arange(len(row)) - (np.cumsum(counts) - counts)[length[order]] + seen[length[order]]
            seen += counts
            offsets = np.append(first[row] + start, len(ids)) * 4
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data, pa.array(np.full(len(row), part, np.int32)), pa.array(ordinal)], names=["doc_id", "piece", "start", "length", "ids", "part", "ordinal"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sweep(runs: Iterable[tuple[int, int, int, int, int]], capacity: int, open_above: int, new_bins: Callable[[int], int]):
    """Best fit of runs (size, kind, a, b, n) in descending size, gaps before pieces of their size.

    Yields (LEFT, rank, run) of pieces that no gap holds and, last, of gaps, the largest first;
    (BELOW, 0, run) of gaps smaller than all runs; (PLACED, 0, run of pieces, bin, per_bin, at).
    Pieces longer than open_above open bins when no gap holds them.
    """
    stack: list[tuple[int, int, int]] = []  # (gap, first bin, bins), the smallest on top
    later: list[tuple[int, int, int]] = []  # heap of (-gap, first bin, bins): gaps smaller than the sizes so far
    rank = 0
    for size, kind, a, b, n in runs:
        while later and -later[0][0] >= size:
            gap, first, bins = heapq.heappop(later)
            stack.append((-gap, first, bins))
        if kind == GAP:
            stack.append((size, a, n))
            continue
        while n:
            if stack:
                gap, first, bins = stack.pop()
            elif size > open_above:
                gap, bins = capacity, -(-n // (capacity // size))
                first = new_bins(bins)
            else:
                yield LEFT, rank, (size, kind, a, b, n), 0, 0, 0
                rank += n
                break
            each = gap // size
            taken = min(n, bins * each)
            yield PLACED, 0, (size, kind, a, b, taken), first, each, capacity - gap
            full, rest = divmod(taken, each)
            if full and gap > each * size:
                heapq.heappush(later, (each * size - gap, first, full))
            if bins > full + bool(rest):
                stack.append((gap, first + full + bool(rest), bins - full - bool(rest)))
            if rest:  # holds another piece of this size
                stack.append((gap - rest * size, first + full, 1))
            n, b = n - taken, b + taken
    rank = 0
    for gap, first, bins in stack:
        yield LEFT, rank, (gap, GAP, first, 0, bins), 0, 0, 0
        rank += bins
    for gap, first, bins in later:
        yield BELOW, 0, (-gap, GAP, first, 0, bins), 0, 0, 0


def match_ranks(runs: Iterable[tuple[int, int, int, int, int]], capacity: int):
    """Runs of a range of ranks, range after range, pieces before gaps: a piece takes the gap met last, each gap one piece. Yields as sweep."""
    stack: list[tuple[int, int, int]] = []
    for size, kind, a, b, n in runs:
        if kind == GAP:
            stack.append((size, a, n))
            continue
        while n and stack:
            gap, first, bins = stack.pop()
            taken = min(n, bins)
            if taken < bins:
                stack.append((gap, first, bins - taken))
            yield PLACED, 0, (size, kind, a, b, taken), first + bins - taken, 1, capacity - gap
            if gap > size:
                yield BELOW, 0, (gap - size, GAP, first + bins - taken, 0, taken), 0, 0, 0
            n, b = n - taken, b + taken
        if n:
            yield BELOW, 0, (size, kind, a, b, n), 0, 0, 0
    for gap, first, bins in stack:
        yield BELOW, 0, (gap, GAP, first, 0, bins), 0, 0, 0


def _rows(found: list[tuple], part: int) -> pa.RecordBatch:
    flat = [(what, part, rank, *run, first, each, at) for what, rank, run, first, each, at in found]
    names = ["what", "range", "rank", "size", "kind", "a", "b", "n", "bin", "per_bin", "at"]
    kinds = [pa.int32() if n in ("what", "range", "kind") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat) if flat else [()] * len(names), kinds)], names=names)


def _swept(rows: DataFrame, how: Callable) -> DataFrame:
    """SWEPT rows of each task's runs in their order."""
    def run(batches):
        part = TaskContext.get().partitionId()
        runs = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        held = []
        for row in how(runs, part):
            held.append(row)
            if len(held) >= 50_000:
                yield _rows(held, part)
                held = []
        yield _rows(held, part)

    return rows.select("size", "kind", "a", "b", "n").mapInArrow(run, SWEPT)


def depths(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(range, gaps waiting before its pieces, gaps waiting before its own gaps) for (pieces, gaps) left by each range."""
    out, deep = [], 0
    for r in sorted(left):
        pieces, gaps = left[r]
        after = max(0, deep - pieces)
        out.append((r, deep, after))
        deep = after + gaps
    return out


def _by_rank(swept: DataFrame, capacity: int, tasks: int) -> DataFrame | None:
    """SWEPT rows of the runs that the ranges left, matched by rank."""
    spark, left = swept.sparkSession, swept.where(F.col("what") == LEFT)
    counts = left.groupBy("range").agg(F.sum(F.when(F.col("kind") == PIECE, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("kind") == GAP, F.col("n")).otherwise(0)).alias("g")).collect()  # one row a task
    known = depths({r["range"]: (r["p"], r["g"]) for r in counts})
    deepest = max((after + r["g"] for r, (_, _, after) in zip(sorted(counts, key=lambda r: r["range"]), known)), default=0)
    if not any(r["p"] for r in counts) or not deepest:
        return None
    width = -(-deepest // tasks)
    deep = spark.createDataFrame(known, "range int, deep long, after long")  # one row a task
    rows = left.join(F.broadcast(deep), "range")
    # levels of the stack: a gap's own, and for pieces those of the gaps that they take, from the top down; below 0: none
    is_gap = F.col("kind") == GAP
    rows = rows.withColumn("low", F.when(is_gap, F.col("after") + F.col("rank")).otherwise(F.col("deep") - F.col("rank") - F.col("n"))).withColumn("high", F.col("low") + F.col("n"))
    # pieces that find no gap at all are left as they are
    without = rows.where(F.col("high") <= 0).select(F.lit(BELOW).alias("what"), "range", "rank", "size", "kind", "a", "b", "n", "bin", "per_bin", "at")
    rows = rows.where(F.col("high") > 0).withColumn("block", F.explode(F.expr(f"sequence(greatest(low, 0L) div {width}, (high - 1) div {width})")))
    # a run's part in a block of levels; pieces below level 0 stay with those of block 0
    first = F.when(F.col("block") == 0, F.least("low", F.lit(0))).otherwise(F.col("block") * width)
    rows = rows.withColumn("x", F.greatest("low", first)).withColumn("y", F.least("high", (F.col("block") + 1) * width))
    rows = rows.select("block", "range", "rank", "size", "kind", F.when(is_gap, F.col("a") + F.col("x") - F.col("low")).otherwise(F.col("a")).alias("a"), F.when(is_gap, F.col("b")).otherwise(F.col("b") + F.col("high") - F.col("y")).alias("b"), (F.col("y") - F.col("x")).alias("n"))
    dealt = rows.repartition(tasks, "block").sortWithinPartitions("block", "range", F.desc("kind"), "rank")

    def how(runs, _):
        return match_ranks(runs, capacity)

    return _swept(dealt, how).union(without)


def place(runs: DataFrame, ws: Workspace, capacity: int, tasks: int | None = None) -> DataFrame:
    """Places of runs of pieces (RUN): part, length, ordinal, n, bin, per_bin, at. tasks: of each sweep, else by the number of runs."""
    spark, most = runs.sparkSession, parts_of(runs.sparkSession)
    placed, open_above, before = [], capacity // 2, None
    for step in range(MAX_STEPS):
        is_piece = F.col("kind") == PIECE
        state = runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.when(is_piece, F.col("n"))), F.lit(0)).alias("pieces"), F.max(F.when(is_piece, F.col("size"))).alias("longest"), F.min(F.when(is_piece, F.col("size"))).alias("shortest")).first()
        if not state["pieces"]:
            break
        end = state["runs"] <= TAIL and tasks is None
        if end:
            open_above = 0
        elif before is not None:
            open_above = state["longest"] // 2 if before - state["pieces"] < 0.02 * before else capacity
        before = state["pieces"]
        n = 1 if end else tasks or max(2, min(most, state["runs"] // RUNS_A_TASK))
        # gaps below every piece left serve no more
        used = runs.where(is_piece | (F.col("size") >= state["shortest"]))
        order = [F.desc("size"), "kind", "a", "b"]
        dealt = (used.coalesce(1) if end else used.repartitionByRange(n, *order)).sortWithinPartitions(*order)

        def how(rows, part, open_above=open_above, step=step):
            made = [0]

            def new_bins(k):
                made[0] += k
                return (step << 52) + (part << 32) + made[0] - k

            return sweep(rows, capacity, open_above, new_bins)

        swept = ws.write(_swept(dealt, how), f"swept-{step}")
        placed.append(swept.where(F.col("what") == PLACED))
        rest = swept.where(F.col("what") != PLACED)
        if not end and (matched := _by_rank(swept, capacity, n)) is not None:
            matched = ws.write(matched, f"matched-{step}")
            placed.append(matched.where(F.col("what") == PLACED))
            rest = swept.where(F.col("what") == BELOW).union(matched.where(F.col("what") == BELOW))
        runs = rest.select("size", "kind", "a", "b", "n")
    else:
        raise RuntimeError(f"packing did not end in {MAX_STEPS} supersteps")
    out = placed[0] if placed else spark.createDataFrame([], SWEPT)
    for p in placed[1:]:
        out = out.union(p)
    return out.select(F.col("a").cast("int").alias("part"), F.col("size").alias("length"), F.col("b").alias("ordinal0"), "n", "bin", "per_bin", "at")


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, end_id: int = 2, tasks: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset for every piece.

    Pieces are joined with the places of their runs by (part, length); ids take part in that shuffle only if the caller selects them.
    """
    ws = Workspace(docs.sparkSession, "packing")
    pieces = ws.write(cut_pieces(docs, capacity, path or tokens.default_path(), end_id).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    runs = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    runs = ws.write(runs.select(F.col("length").alias("size"), F.lit(PIECE).alias("kind"), F.col("part").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "n"), "runs")
    places = place(runs, ws, capacity, tasks)
    in_run = F.col("ordinal") - F.col("ordinal0")
    placed = pieces.join(places, ["part", "length"]).where((in_run >= 0) & (in_run < F.col("n")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids", "ids_crc32",
        (F.col("bin") + F.expr("(ordinal - ordinal0) div per_bin")).alias("sequence_id"),
        (F.col("at") + in_run % F.col("per_bin") * F.col("length")).alias("offset"),
    )
