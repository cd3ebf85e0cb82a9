"""Operator 7 (native): chat formatting by prefix-target expansion.

A conversation is formatted once: each turn as ``### role: text</turn>`` and a line feed. Every
assistant turn is an example of its own whose text is the formatted conversation up to and
including that reply, and whose loss mask covers only the reply's text. As an example's text is
a prefix of the formatted conversation, examples are kept as (stop, loss_start, loss_stop) into
it, so a long conversation takes linear space; ``expand`` gives them as rows with their own text.

Control strings inside texts and roles are escaped reversibly: ``\\`` is written ``\\b``, ``<``
``\\l``, ``#`` ``\\h`` and, in roles, ``:`` ``\\c``. Neither ``<`` nor ``#`` is then part of any
text, so the markers cannot be forged.

Only DataFrame functions are used. Null texts and roles are empty; turns are ordered by turn
(null first), then role, then text, so ties and repeated rows have a fixed order and are all
kept; a null conv_id is a conversation of its own; a conversation without assistant turns has no
examples; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def _lit_replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, role: bool = False) -> Column:
    for old, new in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *([(":", "\\c")] if role else [])):
        text = _lit_replace(text, old, new)
    return text


def unescape(text: Column) -> Column:
    """Every ``\\`` of an escaped text begins a pair, so the pairs can be undone one kind after another, ``\\b`` last."""
    for old, new in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = _lit_replace(text, old, new)
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and examples: array of (turn_no, stop, loss_start, loss_stop), character offsets, stops exclusive."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(COLON))).withColumn("body", escape(F.col("text")))
    head, body = F.char_length("head").cast("long"), F.char_length("body").cast("long")
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("after", F.sum(head + body + len(CLOSE)).over(running)).withColumn("no", F.row_number().over(in_order) - 1)
    stop = F.col("after") - len(CLOSE)
    one = F.struct(F.col("after"), F.concat("head", "body", F.lit(CLOSE)).alias("written"), (F.col("role") == "assistant").alias("target"),
                   F.struct(F.col("no").cast("int").alias("turn_no"), stop.alias("stop"), (stop - body).alias("loss_start"), stop.alias("loss_stop")).alias("example"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return convs.select(
        "conv_id", F.array_join(F.transform("t", lambda t: t["written"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["target"]), lambda t: t["example"]).alias("examples"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, turn_no, text, loss_start, loss_stop."""
    one = formatted.select("conv_id", "formatted", F.explode("examples").alias("e"))
    return one.select("conv_id", "e.turn_no", F.expr("substring(formatted, 1, int(e.stop))").alias("text"), "e.loss_start", "e.loss_stop")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    chunks = F.filter(F.split(formatted, F.lit(CLOSE), -1), lambda c: c != "")
    return F.transform(chunks, lambda c: F.struct(
        unescape(F.substring_index(c, COLON, 1).substr(F.lit(len(OPEN) + 1), F.char_length(c))).alias("role"),
        unescape(c.substr(F.length(F.substring_index(c, COLON, 1)) + len(COLON) + 1, F.char_length(c))).alias("text")))


def replies(formatted: DataFrame, *keys: str) -> DataFrame:
    """The keys of each conversation and loss: the text under the masks of its examples as ``expand`` makes them, unescaped, in order; without examples empty."""
    own = [F.col(k) for k in keys]
    examples = formatted.select(*own, "formatted", F.explode_outer("examples").alias("e"))
    text = F.expr("substring(formatted, 1, int(e.stop))")
    reply = unescape(F.substring(text, (F.col("e.loss_start") + 1).cast("int"), (F.col("e.loss_stop") - F.col("e.loss_start")).cast("int")))
    rows = examples.select(*own, F.when(F.col("e").isNotNull(), F.struct(F.col("e.turn_no"), reply.alias("reply"))).alias("r"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["reply"]), "").alias("loss"))


def masked_text(formatted: Column, examples: Column) -> Column:
    """All text under the loss masks, unescaped, in order."""
    return F.array_join(F.transform(examples, lambda e: unescape(F.substring(formatted, (e["loss_start"] + 1).cast("int"), (e["loss_stop"] - e["loss_start"]).cast("int")))), "")
