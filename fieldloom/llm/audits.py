"""Cheapest repairs of conversations: dynamic programming over persistent audits.

The state of a repair is the last role initial it has put out. Per row and state the
cheapest audit so far is kept as a linked node: audits share their beginnings, a node
holds one row's edits, its ancestors at powers of two and a rolling hash. Of equally
cheap audits the ASCII-least one counts: the two are compared where they first
differ, found by a longest-common-prefix search over the ancestors' hashes, and equal
hashes are verified letter by letter.

Two equally cheap audits of the same rows and end state never begin one another: the
longer one would have inserted turns and returned to the same state for nothing. So
the least beginning stays the least whatever follows, and the cheapest audits of a
stretch of rows, from each state to each state, are all that the rest must know of it:
a long conversation is repaired in stretches that are joined afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

#: The state after an inserted or reroled turn: an assistant answers a user, else a user speaks.
SPOKEN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Turns to be inserted at the end.
CLOSING = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}

FINE, BLANK, REPEATED, TRUNCATED = range(4)

#: A cheapest audit between two states: its cost and letters.
Edge = tuple[int, str]

MODULUS = (1 << 61) - 1
BASE = 0x5DEECE66D


def _steps(initial: str, truncated: bool) -> list[tuple[int, int, str, int]]:
    """What can become of a row that may stay: ``(state before, after, letters, cost)``.

    Inserting before a deletion costs what inserting after it does and is the
    greater audit, so a deletion stands alone. More than two turns in a row lead back
    to a state for nothing.
    """
    out = [(state, state, DELETE, DELETE_COST) for state in STATES]
    extra = TRUNCATED_COST if truncated else 0
    for state in STATES:
        at = state
        for inserted in range(3):
            letters, cost = INSERT * inserted, INSERT_COST * inserted + extra
            out.append((state, SPOKEN[at], letters + REROLE, cost + REROLE_COST))
            if at in KEPT.get(initial, {}):
                out.append((state, KEPT[initial][at], letters + KEEP, cost))
            at = SPOKEN[at]
    least: dict[tuple[int, int], tuple[int, list]] = {}
    for state, after, letters, cost in out:
        best = least.get((state, after))
        if best is None or (cost, letters) < best:
            least[state, after] = (cost, letters)
    return [(state, after, letters, cost) for (state, after), (cost, letters) in least.items()]


STEPS = {(i, t): _steps(i, t) for i in "sua-" for t in (False, True)}


class Audit:
    """An audit as its last piece and the audit before it."""

    __slots__ = ("ancestors", "digest", "length", "piece")

    def __init__(self, before: Audit | None, piece: str, modulus: int = MODULUS):
        self.piece = piece
        if before is None:
            self.ancestors: list[Audit] = []
            self.digest, self.length = 0, 0
            return
        self.digest = (before.digest * BASE + zlib.crc32(piece.encode()) + 1) % modulus
        self.length = before.length + len(piece)
        self.ancestors = [before]
        while len(self.ancestors[-1].ancestors) >= len(self.ancestors):
            self.ancestors.append(self.ancestors[-1].ancestors[len(self.ancestors) - 1])

    def pieces(self) -> list[str]:
        out, at = [], self
        while at.ancestors:
            out.append(at.piece)
            at = at.ancestors[0]
        return out[::-1]

    def __str__(self) -> str:
        return "".join(self.pieces())


def same(one: Audit, other: Audit) -> bool:
    """Whether two audits of the same rows are equal: hashes tell first, letters decide.

    Proven equal, the second takes over the first one's beginnings, so that nothing
    is verified twice.
    """
    if one is other:
        return True
    if one.digest != other.digest or one.length != other.length:
        return False
    a, b, met = one, other, []
    while a is not b:
        if a.piece != b.piece:
            return False
        met.append((a, b))
        a, b = a.ancestors[0], b.ancestors[0]
    for a, b in met:
        b.ancestors = a.ancestors
    return True


def before(one: Audit, other: Audit) -> int:
    """-1, 0 or 1 as the first of two audits of the same rows is less, equal or greater."""
    if same(one, other):
        return 0
    level = len(one.ancestors) - 1
    while level >= 0:
        if level < len(one.ancestors):
            a, b = one.ancestors[level], other.ancestors[level]
            if not same(a, b):
                one, other = a, b
        level -= 1
    return -1 if one.piece < other.piece else 1


class Frontier:
    """The cheapest audit that ends in each state, grown row by row."""

    def __init__(self, states: Iterable[int] = (START,), modulus: int = MODULUS):
        self.modulus = modulus
        root = Audit(None, "", modulus)
        self.best: dict[int, tuple[int, Audit]] = {s: (0, root) for s in states}

    def grow(self, steps: Iterable[tuple[int, int, str, int]]) -> None:
        found: dict[int, tuple[int, Audit, str]] = {}
        for state, after, letters, cost in steps:
            if state not in self.best:
                continue
            own, audit = self.best[state]
            new = (own + cost, audit, letters)
            old = found.get(after)
            if old is None or self._less(new, old):
                found[after] = new
        self.best = {s: (cost, Audit(audit, letters, self.modulus)) for s, (cost, audit, letters) in found.items()}

    @staticmethod
    def _less(new: tuple[int, Audit, str], old: tuple[int, Audit, str]) -> bool:
        if new[0] != old[0]:
            return new[0] < old[0]
        order = before(new[1], old[1])
        return order < 0 or (order == 0 and new[2] < old[2])

    def row(self, initial: str, fault: int, copies: int = 1) -> None:
        """A row, and its further copies, which are repeated."""
        if fault in (BLANK, REPEATED):
            self._delete(copies)
        else:
            self.grow(STEPS[initial if initial in KEPT else "-", fault == TRUNCATED])
            if copies > 1:
                self._delete(copies - 1)

    def _delete(self, rows: int) -> None:
        self.grow([(s, s, DELETE * rows, DELETE_COST * rows) for s in STATES])

    def closed(self) -> tuple[int, Audit]:
        """The cheapest audit that may end the conversation."""
        self.grow([(s, START, INSERT * n, INSERT_COST * n) for s, n in CLOSING.items()])
        return self.best[START]


Row = tuple[str, int, int]


def stretch(rows: Sequence[Row], states: Iterable[int] = STATES) -> list[list[Edge | None]]:
    """The cheapest audits of some rows ``(initial, fault, copies)`` from each state to each state."""
    out: list[list[Edge | None]] = [[None] * 4 for _ in STATES]
    for state in states:
        frontier = Frontier([state])
        for row in rows:
            frontier.row(*row)
        for after, (cost, audit) in frontier.best.items():
            out[state][after] = (cost, str(audit))
    return out


def joined(stretches: Iterable[Sequence[Sequence[Edge | None]]]) -> tuple[int, list[str]]:
    """The cheapest audit of stretches in order: its cost, and the letters of each stretch.

    What closes the conversation goes to the last one.
    """
    frontier = Frontier()
    for edges in stretches:
        frontier.grow(
            (state, after, edges[state][after][1], edges[state][after][0])
            for state in STATES
            for after in STATES
            if edges[state][after] is not None
        )
    cost, audit = frontier.closed()
    pieces = audit.pieces()
    return cost, [*pieces[:-2], "".join(pieces[-2:])] if len(pieces) > 1 else pieces


def repaired(
    rows: Iterable[tuple[str, str, int]], audit: str, state: int = START
) -> Iterator[tuple[str, str] | int]:
    """The turns an audit leaves of rows ``(role, text, copies)``; at last the state it ends in."""
    letters = iter(audit)
    names = {USER: "user", ASSISTANT: "assistant"}

    def inserted(letter: str | None) -> Iterator:
        nonlocal state
        while letter == INSERT:
            state = SPOKEN[state]
            yield names[state], ""
            letter = next(letters, None)
        return letter

    for role, text, copies in rows:
        for _ in range(copies):
            letter = yield from inserted(next(letters))
            if letter == KEEP:
                state = KEPT[role[0]][state]
                yield role, text
            elif letter == REROLE:
                state = SPOKEN[state]
                yield names[state], text
    yield from inserted(next(letters, None))
    yield state
