"""Preference formatting of conversations, in DataFrame functions alone.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (same role and text) is rendered
once, as the prompt; what follows on each side is its completion, with the spans of characters that a model is to learn:
the assistant's words and the mark that closes them. Nothing but the conversations themselves is gathered, each into the
one row that it becomes; neighbours are gathered in one shuffle, by what their ids have in common.

A null role or text counts as empty; turns are ordered by number (nulls first), role and text, repeated rows included;
rows without a conversation id belong to no common conversation, each is one of a single turn and has no neighbour; if
one side has no turns left its completion is empty; an empty table gives no rows; other columns of turns are ignored.
``formatted`` passes the columns of pairs through, and replaces those that have the name of one that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The role whose words are learned.
LEARNED = "assistant"
#: What stands around a turn.
OPEN, OPENED, CLOSE = "<|", "|>\n", "<|end|>\n"


_TURN = "struct<role:string,text:string>"


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, its pair (the id without its lowest bit) and its turns, an ordered array of (role, text); conversations of
    a pair are in one partition."""
    turns = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.filter("conv_id IS NOT NULL").withColumn("pair", F.shiftright("conv_id", 1)).repartition("pair")
    out = known.groupBy("pair", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return out.select("pair", "conv_id", F.transform("turns", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(OPENED), turn["text"], F.lit(CLOSE))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _spans(turns: Column) -> Column:
    """Where the learned turns' words and closing marks are in the rendered text: [start, end) in characters."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    head = lambda t: len(OPEN + OPENED) + F.length(t["role"])
    size = lambda t: head(t) + F.length(t["text"]) + len(CLOSE)
    span = lambda s, t: F.array(F.struct((s["at"] + head(t)).cast("bigint").alias("start"), (s["at"] + size(t)).cast("bigint").alias("end")))
    step = lambda s, t: F.struct((s["at"] + size(t)).cast("bigint").alias("at"), F.when(t["role"] == LEARNED, F.concat(s["spans"], span(s, t))).otherwise(s["spans"]).alias("spans"))
    return F.aggregate(turns, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step)["spans"]


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs: any columns, and chosen and rejected, arrays of (role, text). Adds prompt_turns, prompt, and for each side
    the completion and its learned spans."""
    c, r = F.col("chosen"), F.col("rejected")
    shorter = F.least(F.size(c), F.size(r))
    differ = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: ~F.get(c, i).eqNullSafe(F.get(r, i)))
    pairs = pairs.withColumn("prompt_turns", F.when(shorter == 0, 0).otherwise(F.coalesce(F.array_min(differ), shorter)))
    n = F.col("prompt_turns")
    rest = lambda x: F.slice(x, n + 1, F.size(x) - n)
    pairs = pairs.withColumn("prompt", _rendered(F.slice(c, F.lit(1), n)))
    for side in ("chosen", "rejected"):
        pairs = pairs.withColumn(f"{side}_completion", _rendered(rest(F.col(side)))).withColumn(f"{side}_spans", _spans(rest(F.col(side))))
    return pairs


def answered_by_neighbours(turns: DataFrame) -> DataFrame:
    """A pair for each conversation: chosen as it is; rejected with the last answer of the assistant, and what follows,
    replaced by the last answer in the conversation whose id differs in the lowest bit (by nothing if that has none)."""
    convs = gathered(turns)
    t, none = F.col("turns"), F.array().cast(f"array<{_TURN}>")
    last = lambda x: F.array_max(F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["role"] == LEARNED))
    convs = convs.withColumn("at", last(t)).withColumn("answer", F.when(F.col("at").isNotNull(), F.array(F.get(t, F.col("at")))))
    order = Window.partitionBy("pair").orderBy("conv_id")
    convs = convs.withColumn("other", F.coalesce(F.lag("answer").over(order), F.lead("answer").over(order))).select("conv_id", "turns", "at", "other")
    single = F.array(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    alone = turns.filter("conv_id IS NULL").select("conv_id", single.alias("turns"))
    convs = convs.unionByName(alone.withColumn("at", last(t)).withColumn("other", F.lit(None).cast(f"array<{_TURN}>")))
    swapped = F.concat(F.slice(t, F.lit(1), F.col("at")), F.coalesce("other", none))
    return convs.select("conv_id", t.alias("chosen"), F.when(F.col("at").isNull(), t).otherwise(swapped).alias("rejected"))
