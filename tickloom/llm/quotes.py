"""Conversations in reply order, linked by the passages that messages quote.

A line's quote level is its number of leading '>' signs. Quoted lines and
sentences are normalised and hashed, and joined to the first message of the
conversation that says them in its own words. A message replies to the message
that says most of what it quotes at its lowest matched level. Threads follow
these links; all of it is joins and aggregations, and no conversation is ever
gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import session
from tickloom.llm import common
from tickloom.operators.slices import numbered

# Quote signs may be set apart; one blank after them belongs to the marking.
QUOTED = r"(?s)^((?:[ \t]*>)+)[ \t]?(.*)$"
ATTRIBUTION = r"(?s)^[ \t]*on .*wrote:[ \t\r]*$"
SENTENCE_END = r"([.!?]) "


def _lines(text: Column) -> Column:
    """Per line its quote level and its body."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 1), "[^>]", "")).alias("level"),
            F.when(line.rlike(QUOTED), F.regexp_extract(line, QUOTED, 2)).otherwise(line).alias("body"),
        ),
    )


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\f\x0B]+", " "))


def _units(bodies: Column) -> Column:
    """Normalised lines and sentences of the lines of one level."""
    sentences = F.split(F.regexp_replace(_plain(F.array_join(bodies, " ")), SENTENCE_END, "$1\n"), "\n")
    return F.filter(F.array_distinct(F.concat(F.transform(bodies, _plain), sentences)), lambda u: u != "")


def _own(lines: Column, quotes: Column) -> Column:
    """Bodies of the message's own lines; attribution lines go where something is quoted."""
    mine = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"])
    return F.when(quotes, F.filter(mine, lambda x: ~F.lower(x).rlike(ATTRIBUTION))).otherwise(mine)


def _roots(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, root, depth) of every linked message, by pointer doubling."""
    spark = links.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(session.scratch_root(spark))
    state = links.select("conv", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")).checkpoint()
    while True:
        above = state.select(
            "conv", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more")
        )
        joined = state.join(above, ["conv", "root"], "left").select(
            "conv",
            "turn",
            "parent",
            F.coalesce("higher", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("higher").isNotNull().alias("moved"),
        )
        joined = joined.checkpoint()
        if joined.where("moved").isEmpty():
            return joined.drop("moved")
        state = joined.drop("moved")


def reply_order(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turn, role, text, quoted_units, linked_units, parent_turn, thread_turn, depth, position).

    `text` is the message without quoted lines, line by line, trimmed;
    `quoted_units` counts the distinct (level, passage) pairs that it quotes and
    `linked_units` those found in an earlier message. `parent_turn` is the
    message it replies to, null if nothing is linked; ties go to the later
    message. `position` numbers a conversation from 1 in reply order: by the
    first turn of the thread, then by depth in it, then by turn.

    A null text is an empty message. A message with a null conversation or turn
    is linked with nothing; null conversations are numbered together. Repeated
    rows are linked alike and stand next to each other. Extra columns are not
    looked at; an empty table gives no rows.
    """
    base = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), _lines(F.col(text_col)).alias("lines")
    )
    quotes = F.exists("lines", lambda x: x["level"] > 0)
    parsed = base.withColumn("own", _own(F.col("lines"), quotes))
    known = F.col("conv").isNotNull() & F.col("turn").isNotNull()

    of_level = F.transform(
        F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"])),
        lambda level: F.struct(
            level.alias("level"),
            _units(
                F.transform(F.filter(F.col("lines"), lambda x: x["level"] == level), lambda x: x["body"])
            ).alias("units"),
        ),
    )
    quoted = (
        parsed.where(known & quotes)
        .select("conv", "turn", F.explode(of_level).alias("q"))
        .select("conv", "turn", "q.level", F.explode("q.units").alias("unit"))
        .select("conv", "turn", "level", F.xxhash64("unit").alias("unit"))
        .distinct()
    )
    said = (
        parsed.where(known)
        .select("conv", "turn", F.explode(_units(F.col("own"))).alias("unit"))
        .groupBy("conv", F.xxhash64("unit").alias("unit"))
        .agg(F.min("turn").alias("origin"))
    )
    quoted = common.stored(quoted.join(said, ["conv", "unit"], "left"), "quoted-units")
    earlier = F.col("origin") < F.col("turn")
    counted = quoted.groupBy("conv", "turn").agg(
        F.count("*").alias("quoted_units"), F.count(F.when(earlier, True)).alias("linked_units")
    )
    votes = quoted.where(earlier).groupBy("conv", "turn", "level", "origin").agg(F.count("*").alias("votes"))
    links = votes.groupBy("conv", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("level"), "votes", "origin"))["origin"].alias("parent")
    )
    placed = _roots(links)
    rows = (
        parsed.select("conv", "turn", "role", F.trim(F.array_join("own", "\n")).alias("text"))
        .join(placed, ["conv", "turn"], "left")
        .join(counted, ["conv", "turn"], "left")
        .select(
            F.col("conv").alias("conv_id"),
            "turn",
            "role",
            "text",
            F.coalesce("quoted_units", F.lit(0).cast("long")).alias("quoted_units"),
            F.coalesce("linked_units", F.lit(0).cast("long")).alias("linked_units"),
            F.col("parent").alias("parent_turn"),
            F.coalesce("root", "turn").alias("thread_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )
    ordered = numbered(rows, ["conv_id", "thread_turn", "depth", "turn", "role", "text"], "number")
    ordered = common.stored(ordered, "reply-order")
    starts = ordered.groupBy(F.col("conv_id").alias("first_of")).agg(F.min("number").alias("start"))
    return (
        ordered.join(starts, F.col("conv_id").eqNullSafe(F.col("first_of")))
        .withColumn("position", F.col("number") - F.col("start") + 1)
        .drop("number", "start", "first_of")
        .withColumnsRenamed({"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    )
