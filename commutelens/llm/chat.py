"""Chat formatting in budgeted windows, with built-in functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. Each span becomes one window of training text:
the system turn again, then a limited history of turns that end right before the span, then the span's own turns. A
loss mask covers the assistant turns of the span itself; repeated ones are never targets again, so every assistant
text is learned from once.

Template: ``<s>`` opens a window; a turn is ``[TAG] text [/TAG]`` with the tags of its role, and assistant turns end in
``</s>``. Where a text holds one of these control strings, a backslash goes in after its bracket; where it holds one
that looks escaped already, it gets one more, so that removing one from each gives the text back.

Prefix sums have two levels, totals of blocks of turn numbers first and rows inside a block second, so no task sorts a
whole conversation. The spans of one conversation are spread over tasks.

Results: null texts and roles count as empty; rows are ordered by turn (null first), role and text, and repeated rows
are turns of their own. A null conv_id is one conversation. The first system turn is the one retained. An empty table
gives no windows. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAGS = {"user": "INST", "system": "SYS", "assistant": "ANS"}
OTHER_TAG = "ROLE"
_CONTROL = r"/?(?:s>|INST\]|SYS\]|ANS\]|ROLE)"
_TURN = r"(?s)\[(INST|SYS|ANS|ROLE ([^\]]*))\] (.*?) \[/(?:INST|SYS|ANS|ROLE)\]"


@dataclass(frozen=True)
class ChatParams:
    #: Tokens of a window, and of the history it repeats.
    budget: int = 2048
    history: int = 256
    #: Least tokens of a span, where a system turn fills the window.
    least_span: int = 128
    #: Tokens that the template adds to a turn.
    overhead: int = 4
    #: Turn numbers per block of the prefix sums.
    block: int = 256


PARAMS = ChatParams()


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def _opening(role: Column) -> Column:
    other = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))
    tag = F.concat(F.lit(f"[{OTHER_TAG} "), other, F.lit("] "))
    for name, known in TAGS.items():
        tag = F.when(role == name, F.lit(f"[{known}] ")).otherwise(tag)
    return tag


def _closing(role: Column) -> Column:
    tag = F.lit(f" [/{OTHER_TAG}]")
    for name, known in TAGS.items():
        tag = F.when(role == name, F.lit(f" [/{known}]" + ("</s>" if name == "assistant" else ""))).otherwise(tag)
    return tag


def role_of_tag(tag: Column, other: Column) -> Column:
    role = F.replace(F.replace(other, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%"))
    for name, known in TAGS.items():
        role = F.when(tag == known, F.lit(name)).otherwise(role)
    return role


def words(text: Column) -> Column:
    """Default count of tokens."""
    return F.size(F.split(text, r"\s+"))


def with_prefix_sums(turns: DataFrame, params: ChatParams = PARAMS, tokens=words) -> DataFrame:
    """(conv_id, place, role, text, before, size, total): position, and tokens before, in, and of the conversation."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns(
        {
            "size": (tokens(F.col("text")) + params.overhead).cast("bigint"),
            "block": F.floor(F.col("turn") / params.block),
        }
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    earlier = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    open_ = earlier.rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("n").over(open_), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("tokens").over(open_), F.lit(0)).alias("tokens_before"),
        F.sum("tokens").over(W.partitionBy("conv_id")).alias("total"),
    )
    inside = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    here = F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))
    return (
        rows.withColumns(
            {
                "_row": F.row_number().over(inside),
                "_sum": F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)),
            }
        )
        .join(carried, here)
        .select(
            "conv_id",
            (F.col("n_before") + F.col("_row") - 1).alias("place"),
            "role",
            "text",
            (F.col("tokens_before") + F.col("_sum") - F.col("size")).alias("before"),
            "size",
            "total",
        )
    )


def windows(turns: DataFrame, params: ChatParams = PARAMS, tokens=words) -> DataFrame:
    """(conv_id, window, formatted, loss, n_repeated): text, its target stretches in code points, and how many of its
    turns are repeated. Own turns fit the budget with everything repeated unless a single turn is larger than a span.
    """
    summed = with_prefix_sums(turns, params, tokens)
    systems = (
        summed.filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min(F.struct("place", "role", "text", "size")).alias("s"))
        .select(F.col("conv_id").alias("s_conv"), "s")
    )
    # A span takes turns that start inside its stride; half the room as stride, as the last one may be as long again.
    room = F.lit(params.budget - params.history) - F.coalesce(F.col("s.size"), F.lit(0))
    stride = F.greatest(F.lit(params.least_span), F.floor(room / 2))
    placed = (
        summed.join(systems, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
        .withColumn("stride", stride)
        .withColumn("system_place", F.col("s.place"))
        .drop("s", "s_conv")
        .withColumn("window", F.floor(F.col("before") / F.col("stride")))
    )
    span = W.partitionBy("conv_id", "window")
    ended = placed.withColumn("until", F.max(F.col("before") + F.col("size")).over(span))
    is_system = F.coalesce(F.col("place") == F.col("system_place"), F.lit(False))
    again = (
        (F.col("until") < F.col("total")) & (F.col("until") - F.col("before") <= params.history) & ~is_system
    )
    own = F.struct(F.col("window").alias("to"), F.lit(2).alias("kind"))
    history = F.when(again, F.struct(F.floor(F.col("until") / F.col("stride")).alias("to"), F.lit(1).alias("kind")))
    copies = ended.select("conv_id", "place", "role", "text", F.inline(F.array_compact(F.array(own, history))))
    later = (
        ended.groupBy("conv_id", "window")
        .agg(F.min("place").alias("first"))
        .join(systems, F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("first") > F.col("s.place")))
        .select("conv_id", "s.place", "s.role", "s.text", F.col("window").alias("to"), F.lit(0).alias("kind"))
    )
    turn = F.struct(
        "kind",
        "place",
        _opening(F.col("role")).alias("opening"),
        escaped(F.col("text")).alias("body"),
        _closing(F.col("role")).alias("closing"),
        (F.col("role") == "assistant").alias("answers"),
    )
    gathered = (
        copies.unionByName(later)
        .groupBy("conv_id", F.col("to").alias("window"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    start = F.struct(F.length(F.lit("<s>")).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(seen: Column, t: Column) -> Column:
        begin = seen["at"] + F.length(t["opening"])
        end = begin + F.length(t["body"])
        target = F.array(F.struct(begin.alias("start"), end.alias("end")))
        loss = F.when(t["answers"] & (t["kind"] == 2), F.concat(seen["loss"], target)).otherwise(seen["loss"])
        return F.struct((end + F.length(t["closing"])).alias("at"), loss.alias("loss"))

    whole = F.transform("turns", lambda t: F.concat(t["opening"], t["body"], t["closing"]))
    return gathered.select(
        "conv_id",
        "window",
        F.concat(F.lit("<s>"), F.array_join(whole, "")).alias("formatted"),
        F.aggregate("turns", start, step, lambda seen: seen["loss"]).alias("loss"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"),
    )


def turns_of(formatted: Column) -> Column:
    """Turns of a window's text, array<struct<role, text>>."""
    tags, others, texts = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2, 3))
    return F.transform(
        F.arrays_zip(tags.alias("tag"), others.alias("other"), texts.alias("text")),
        lambda t: F.struct(role_of_tag(t["tag"], t["other"]).alias("role"), unescaped(t["text"]).alias("text")),
    )


def targets_of(formatted: Column, loss: Column) -> Column:
    """Texts under the loss mask, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def read_back(formed: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets, chars) of windows: own turns only, and what the mask covers."""
    own = F.expr("slice(every, n_repeated + 1, greatest(size(every) - n_repeated, 0))")
    return formed.withColumn("every", turns_of(F.col("formatted"))).select(
        "conv_id",
        "window",
        own.alias("turns"),
        targets_of(F.col("formatted"), F.col("loss")).alias("targets"),
        F.length("formatted").alias("chars"),
    )
