"""Conversations rendered as one text each, in a template that is read back exactly.

A turn is ``<s>``, its role, ``<t>``, a sign for how its text is written, its text and
``</s>``. The sign ``=`` says that the text stands as it is, ``~`` that it is escaped.
Escaping writes a backslash after each ``<``, ``[`` and backslash, so no control
string of this template, nor of others that begin with these, is left in a text.
Roles are always escaped.

A deterministic parser of DataFrame functions cuts the rendering at every ``</s>``
and reads the turns back. First every text is written as it is. Where the reading
differs from the source, the turns that differ are written again, escaped; where that
still differs, all turns are. An escaped text holds no ``</s>``, so in the end every
cut is the end of a turn and the reading is the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, CLOSE = "<s>", "<t>", "</s>"
PLAIN, ESCAPED = "=", "~"
#: The role whose texts are learned.
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def _rendered(turn: Column, escaped: Column) -> Column:
    text = F.when(escaped, F.concat(F.lit(ESCAPED), escape(turn["text"]))).otherwise(
        F.concat(F.lit(PLAIN), turn["text"])
    )
    return F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(TEXT), text, F.lit(CLOSE))


def _from(text: Column, place: Column) -> Column:
    return text.substr(place, F.length(text))


def read_turns(rendered: Column) -> Column:
    """The turns of a rendering: an array of (role, text)."""
    parts = F.split(rendered, CLOSE)
    # What follows the last turn's end is empty.
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inner = _from(part, F.lit(len(OPEN) + 1))
        role = F.substring_index(inner, TEXT, 1)
        body = _from(inner, F.length(role) + len(TEXT) + 1)
        raw = _from(body, F.lit(2))
        text = F.when(body.startswith(ESCAPED), unescape(raw)).otherwise(raw)
        return F.struct(unescape(role).alias("role"), text.alias("text"))

    return F.transform(parts, turn)


def _loss(turns: Column, segments: Column) -> Column:
    """Where the learned texts stand in the rendering: (start from 0, length)."""
    none = F.array().cast("array<struct<start:long,length:long>>")

    def step(state: Column, pair: Column) -> Column:
        size = F.length(pair["segment"])
        header = len(OPEN) + F.length(escape(pair["role"])) + len(TEXT) + 1
        span = F.struct(
            (state["at"] + header).cast("long").alias("start"),
            (size - header - len(CLOSE)).cast("long").alias("length"),
        )
        spans = F.when(pair["role"] == LEARNED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + size).cast("long").alias("at"), spans.alias("spans"))

    pairs = F.zip_with(turns, segments, lambda t, s: F.struct(t["role"].alias("role"), s.alias("segment")))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return F.aggregate(pairs, start, step, lambda state: state["spans"])


def formatted_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss`` from rows ``conv_id, turn, role, text``.

    ``loss`` lists where the assistant's texts stand, in code points. Turns stand by
    ``turn``, then role and text; repeated rows are repeated turns. Null roles and
    texts are empty ones, a null turn comes first, and rows without conv_id make one
    conversation of their own. A conversation is one row of the result and so has to
    fit into memory. An empty table gives an empty result.
    """
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("row"),
    )
    grouped = given.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    turns = grouped.select("conv_id", source.alias("turns"))

    plain = F.transform("turns", lambda t: _rendered(t, F.lit(False)))
    first = turns.withColumn("segments", plain).withColumn("read", read_turns(F.concat_ws("", "segments")))
    conflicts = F.transform("turns", lambda t, i: ~F.get("read", i).eqNullSafe(t))
    marked = first.withColumn(
        "conflicts",
        F.when(F.col("read") == F.col("turns"), F.transform("turns", lambda _: F.lit(False))).otherwise(conflicts),
    )
    again = F.zip_with("turns", "conflicts", _rendered)
    second = marked.withColumn("segments", again).withColumn("read", read_turns(F.concat_ws("", "segments")))
    every = F.transform("turns", lambda t: _rendered(t, F.lit(True)))
    settled = F.when(F.col("read") == F.col("turns"), F.col("segments")).otherwise(every)
    return second.select("conv_id", "turns", settled.alias("segments")).select(
        "conv_id", F.concat_ws("", "segments").alias("formatted"), _loss(F.col("turns"), F.col("segments")).alias("loss")
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted texts, as counts and digests."""
    text = F.col("formatted")
    turns = read_turns(text)

    def learned(span: Column) -> Column:
        raw = text.substr((span["start"] + 1).cast("int"), span["length"].cast("int"))
        sign = text.substr(span["start"].cast("int"), F.lit(1))
        return F.when(sign == ESCAPED, unescape(raw)).otherwise(raw)

    read = formatted.select(
        "conv_id",
        turns.alias("turns"),
        F.concat_ws("", F.transform("loss", learned)).alias("learned"),
        F.length(text).cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
