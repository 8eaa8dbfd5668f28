"""Structure repair of conversations: faults, cheapest edits, and what they leave.

Rows are laid out in order by a range partitioning over conversation, turn, role and
text, so a conversation with a third of all rows fills many partitions; equal rows are
counted before. Tasks read their rows in order, a bounded stretch at a time.
A conversation that lies in one stretch is repaired there. Of the others each stretch
gives the cheapest audits from each state to each state (``audits``); these are
joined per conversation, and each stretch then reads off its own edits. Only the hash
of the repaired conversation passes over its stretches one after another, as a
digest of one text must: they stream through, one in memory at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import audits
from fieldloom.llm.arrays import bound_batches
from fieldloom.session import written

#: Rows and characters of text in one stretch.
STRETCH_ROWS = 2_048
STRETCH_CHARS = 4 << 20
BLANKS = " \t\n\v\f\r"

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
STRETCH = (
    "conv_id {kind}, part int, number int, whole boolean, first_turn long, last_turn long, turns long, blank long, "
    "duplicate long, truncated long, illegal long, head string, tail string, costs array<long>, pieces array<string>, "
    "roles array<string>, texts array<string>, copies array<long>, cost long, audit string, repaired_sha256 string"
)
PATH = "conv_id {kind}, part int, number int, piece string, total long"
LEGAL = {"su", "ua", "au"}


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: planted faults, fixed by the row's key.

    The checksum of ``conv_id:turn`` drops, empties, unpunctuates, repeats or reroles one
    row in twenty each. Nulls become one space (in the key too; ids and turns stay null).
    A dropped row stays with no copies, so that its conversation is still known.
    """
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(key.cast("binary")) % 20
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return given.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the same form; nulls become one space."""
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number, and the first fault of the first of them.

    A text seen earlier in its role is told by the first turn it has there: an
    aggregate and a join on conversation, role and text, which Spark can both split.
    """
    keys = ["conv_id", "role", "text"]
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    rows = rows.withColumn("last", last)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = rows.filter("copies > 0 and last <> ''").groupBy(*keys).agg(F.min(turn).alias("first"))
    firsts = firsts.select(*[F.col(k).alias(f"_{k}") for k in keys], "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    fault = (
        F.when(F.col("last") == "", audits.BLANK)
        .when(F.col("first") < turn, audits.REPEATED)
        .when(~F.col("last").isin(".", "!", "?"), audits.TRUNCATED)
        .otherwise(audits.FINE)
    )
    return rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


@dataclass
class Stretch:
    """Rows of one conversation in a row, and what was counted in them."""

    number: int = 0
    rows: list[audits.Row] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    chars: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    head: str | None = None
    tail: str | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        initial = role[:1]
        if self.head is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.tail = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault == audits.BLANK:
            self.blank += copies
        else:
            self.duplicate += copies - (fault != audits.REPEATED)
            self.truncated += fault == audits.TRUNCATED
        self.rows.append((initial, fault, copies))
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(copies)
        self.chars += len(text)

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= STRETCH_CHARS


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _digest(digest, turns: Iterator, begun: bool) -> tuple[bool, int]:
    """Add repaired turns to a hash; returns whether it has any now, and the state they end in."""
    state = audits.START
    for turn in turns:
        if isinstance(turn, int):
            state = turn
        else:
            digest.update((("\n" if begun else "") + ":".join(turn)).encode())
            begun = True
    return begun, state


def _stretch_row(conv, part: int, s: Stretch, whole: bool) -> dict:
    out = {
        "conv_id": conv, "part": part, "number": s.number, "whole": whole, "first_turn": s.first_turn,
        "last_turn": s.last_turn, "turns": s.turns, "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated,
        "illegal": s.illegal, "head": s.head, "tail": s.tail,
    }
    if whole:
        frontier = audits.Frontier()
        for row in s.rows:
            frontier.row(*row)
        cost, audit = frontier.closed()
        digest = hashlib.sha256()
        letters = str(audit)
        _digest(digest, audits.repaired(zip(s.roles, s.texts, s.copies, strict=True), letters), False)
        return out | {"cost": cost, "audit": letters, "repaired_sha256": digest.hexdigest()}
    edges = [e for row in audits.stretch(s.rows) for e in row]
    return out | {
        "costs": [None if e is None else e[0] for e in edges],
        "pieces": [None if e is None else e[1] for e in edges],
        "roles": s.roles,
        "texts": s.texts,
        "copies": s.copies,
    }


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    """Result rows as small batches; a row that holds texts goes alone."""
    waiting: list[dict] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= size or row.get("texts"):
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _stretches(schema: pa.Schema, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        conv, stretch, first = None, None, True
        for own, turn, role, text, copies, fault in _in_order(batches):
            if stretch is None or own != conv:
                if stretch is not None:
                    # The first conversation may have begun in the partition before.
                    yield _stretch_row(conv, part, stretch, whole=not first and not stretch.number)
                    first = False
                conv, stretch = own, Stretch()
            elif stretch.full(size):
                yield _stretch_row(conv, part, stretch, whole=False)
                stretch = Stretch(stretch.number + 1)
            if copies:
                stretch.add(turn, role, text, copies, fault)
        if stretch is not None:
            # The last one may go on in the next partition.
            yield _stretch_row(conv, part, stretch, whole=False)

    return lambda batches: _batched(rows(batches), schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """The rows of each conversation, as they stream by."""
    stream = (row for batch in batches for row in batch.to_pylist())
    row = next(stream, None)
    while row is not None:
        conv = row["conv_id"]

        def own() -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv_id"] == conv:
                yield row
                row = next(stream, None)

        yield conv, own()


def _paths(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, stretches in _grouped(batches):
            places = []

            def edges() -> Iterator[list]:
                for s in stretches:
                    places.append((s["part"], s["number"]))
                    flat = [None if c is None else (c, p) for c, p in zip(s["costs"], s["pieces"], strict=True)]
                    yield [flat[i : i + 4] for i in range(0, 16, 4)]

            cost, pieces = audits.joined(edges())
            for (part, number), piece in zip(places, pieces, strict=True):
                yield {"conv_id": conv, "part": part, "number": number, "piece": piece, "total": cost}

    return lambda batches: _batched(rows(batches), schema)


def _results(schema: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, stretches in _grouped(batches):
            digest, begun, state, letters, cost = hashlib.sha256(), False, audits.START, [], 0
            sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            first, last, turns, tail = None, None, 0, None
            for s in stretches:
                given = zip(s["roles"] or (), s["texts"] or (), s["copies"] or (), strict=True)
                begun, state = _digest(digest, audits.repaired(given, s["piece"], state), begun)
                letters.append(s["piece"])
                cost = s["total"]
                for name in sums:
                    sums[name] += s[name]
                if s["head"] is not None:
                    sums["illegal"] += tail is not None and tail + s["head"] not in LEGAL
                    tail = s["tail"]
                if s["turns"]:
                    turns += s["turns"] - (s["first_turn"] == last)
                    first = s["first_turn"] if first is None else first
                    last = s["last_turn"]
            yield {
                "conv_id": conv, "gaps": _gaps(first, last, turns), **sums, "cost": cost,
                "audit": "".join(letters), "repaired_sha256": digest.hexdigest(),
            }

    return lambda batches: _batched(rows(batches), schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repaired_conversations(rows: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Takes ``conv_id, turn, role, text, copies`` (``damaged``, ``undamaged``) and gives a
    row per conversation, also for one whose rows all have no copies: zeros, an
    empty audit and the hash of an empty text. Rows without id are one conversation.
    Rows go by turn, nulls first; rows of one turn by role and text. Null turns count
    in no gap. Repeated rows stand side by side, all but the first are duplicates. An
    empty text is blank; a role that is no system, user or assistant by its initial
    must be given another or go. Texts of any length are read whole. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    result, stretch, path = (ddl.format(kind=kind) for ddl in (RESULT, STRETCH, PATH))
    order = ("conv_id", "turn", "role", "text")
    laid = with_faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(laid.mapInArrow(_stretches(_arrow(spark, stretch), stretch_rows), stretch), "stretches")

    gaps = F.coalesce(F.expr("last_turn - first_turn + 1 - turns"), F.lit(0).cast("long")).alias("gaps")
    whole = found.filter("whole").select("conv_id", gaps, *COUNTS[1:], "audit", "repaired_sha256")

    parts = found.filter("not whole").drop("whole", "cost", "audit", "repaired_sha256")
    place = ("conv_id", "part", "number")

    def by_conversation(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions(*place)

    edges = by_conversation(parts.select(*place, "costs", "pieces"))
    paths = written(edges.mapInArrow(_paths(_arrow(spark, path)), path), "paths")
    paths = paths.select("piece", "total", *[F.col(c).alias(f"_{c}") for c in place])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number"))
    edited = parts.drop("costs", "pieces").join(paths, same).drop(*[f"_{c}" for c in place])
    rest = by_conversation(edited).mapInArrow(_results(_arrow(spark, result)), result)
    return whole.unionByName(rest)
