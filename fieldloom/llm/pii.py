"""Personal data in texts: fixed patterns, and a character BiLSTM-CRF that adds to them.

The tagger learns from labelled spans: those the patterns find in a bounded sample of
texts, and rule-made rewritings of them (other separators, no plus sign). A text is
read in overlapping windows. Only windows that hold a digit, an ``@`` or a written
``(at)`` are read: every kind holds one of these. Scores of overlapping windows are
averaged, nearer to a window's middle counting more, and each run of windows is
decoded as one sequence, so a span that crosses windows is found whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import tagger
from fieldloom.llm.arrays import bound_batches
from fieldloom.llm.samples import taken

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = r"[0-9@]|[(\[]at[)\]]"

WINDOW = 64
STEP = 32
#: Texts, as a mean, whose spans the tagger learns from.
FIT_TEXTS = 600
FIT_PLACES = 8
#: Training windows at most; of more, every so-manieth in text order.
FIT_WINDOWS = 4_000
STEPS = 260

Span = tuple[int, int, str]
SPANS = "array<struct<kind:string,start:int,end:int>>"
RESULT = f"base {SPANS}, added {SPANS}"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each ``@`` backwards: linear on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and EMAIL_NAME.match(text[begin - 1]):
            begin -= 1
        host = EMAIL_HOST.match(text, at + 1) if begin < at else None
        if host:
            yield begin, host.end()
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns and their checks find, by start and then kind."""
    found: list[Span] = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        # Leading zeros do not count against a part.
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _rewritten(text: str, kind: str, form: int) -> str:
    """A labelled span as people also write it."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        return (text, text.replace("@", "(at)"), text.replace("@", " @ "), text.replace("@", "[at]"))[form]
    if kind == "ip":
        return (text, text.replace(".", " . "), text.replace(".", ". "), text)[form]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return (text, ".".join(fours), "_".join(fours), "/".join(fours))[form]
    tail = [digits[-10:-7], digits[-7:-4], digits[-4:]]
    return (text, "-".join(tail), "({}) {}-{}".format(*tail), ".".join(tail))[form]


def _varied(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with some spans rewritten, and where the spans are then."""
    out, labelled, done = [], [], 0
    size = 0
    for begin, end, kind in spans:
        if begin < done:
            continue
        piece = text[done:begin]
        new = _rewritten(text[begin:end], kind, int(rng.integers(0, 4)))
        out += [piece, new]
        size += len(piece)
        labelled.append((size, size + len(new), kind))
        size += len(new)
        done = end
    return "".join([*out, text[done:]]), labelled


def _window_starts(text: str) -> list[int]:
    """Multiples of STEP whose window holds a trigger."""
    starts: set[int] = set()
    for m in re.finditer(TRIGGER, text):
        block = m.start() // STEP
        starts.add(block * STEP)
        if block:
            starts.add((block - 1) * STEP)
    return sorted(starts)


def _window_classes(classes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([classes, np.full(WINDOW, tagger.LINE, np.int16)])
    return np.stack([padded[s : s + WINDOW] for s in starts])


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length + WINDOW, np.int64)
    for begin, end, kind in spans:
        if not out[begin:end].any():
            out[begin:end] = 2 + 2 * KINDS.index(kind)
            out[begin] -= 1
    return out


def fit_tagger(texts: list[str], steps: int = STEPS) -> tagger.Params | None:
    """A tagger from the base spans of ``texts``; None without any span."""
    rng = np.random.default_rng(6)
    chars, tags = [], []
    for text in texts:
        spans = base_spans(text)
        for source, labelled in ((text, spans), _varied(text, spans, rng)) if spans else ((text, spans),):
            starts = _window_starts(source)
            if not starts:
                continue
            gold = _tags(len(source), labelled)
            chars.append(_window_classes(tagger.char_classes(source), starts))
            tags.append(np.stack([gold[s : s + WINDOW] for s in starts]))
    if not chars or not any(t.any() for t in tags):
        return None
    x, y = np.concatenate(chars), np.concatenate(tags)
    every = -(-len(x) // FIT_WINDOWS)
    return tagger.train(x[::every], y[::every], len(KINDS), steps)


@dataclass(frozen=True)
class PiiModel:
    params: tagger.Params | None


def fit_pii(docs: DataFrame, rows: int = FIT_TEXTS, steps: int = STEPS) -> PiiModel:
    """A model from about ``rows`` texts with a trigger, taken by the hash of the text.

    Of each of these the tagger learns from the surroundings of the first
    ``FIT_PLACES`` triggers; all of a text is searched.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select("text").filter(F.col("text").rlike(TRIGGER))
    chosen = texts.filter(taken(F.xxhash64("text"), rows, texts.count())).distinct()
    around = F.expr("regexp_extract_all(text, '(?s).{0,120}?(?:[0-9@]|[(\\\\[]at[)\\\\]]).{0,120}', 0)")
    # Only the surroundings of triggers go to the driver.
    parts = chosen.select(F.explode(F.slice(around, 1, FIT_PLACES)).alias("part")).distinct()
    return PiiModel(fit_tagger(sorted(r["part"] for r in parts.collect()), steps))


def _merged(scores: np.ndarray, starts: list[int], length: int) -> list[tuple[int, np.ndarray]]:
    """Runs of overlapping windows as (start, scores), each place averaged."""
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    runs, i = [], 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and starts[j] == starts[j - 1] + STEP:
            j += 1
        begin, end = starts[i], min(length, starts[j - 1] + WINDOW)
        total = np.zeros((starts[j - 1] + WINDOW - begin, scores.shape[2]), np.float32)
        weights = np.zeros(len(total), np.float32)
        for k in range(i, j):
            at = starts[k] - begin
            total[at : at + WINDOW] += scores[k] * weight[:, None]
            weights[at : at + WINDOW] += weight
        runs.append((begin, (total / weights[:, None])[: end - begin]))
        i = j
    return runs


def _plausible(span: str, kind: str) -> bool:
    """Whether a tagged span passes its kind's checks, however it is written."""
    parts = re.findall(r"[0-9]+", span)
    digits = "".join(parts)
    if kind == "email":
        return bool(re.search(r"@|[(\[]at[)\]]", span)) and "." in span
    if kind == "ip":
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def _spans_of(path: np.ndarray, begin: int, text: str) -> Iterator[Span]:
    i = 0
    while i < len(path):
        if not path[i]:
            i += 1
            continue
        kind = (path[i] - 1) // 2
        j = i + 1
        while j < len(path) and path[j] == 2 + 2 * kind:
            j += 1
        span = text[begin + i : begin + j]
        trimmed = span.strip(" \t\r\n.,;:")
        start = begin + i + len(span) - len(span.lstrip(" \t\r\n.,;:"))
        name = KINDS[kind]
        if _plausible(trimmed, name):
            yield start, start + len(trimmed), name
        i = j


def added_spans(texts: list[str], base: list[list[Span]], params: tagger.Params | None) -> list[list[Span]]:
    """What the tagger finds beside the base spans, free of overlaps with them."""
    out: list[list[Span]] = [[] for _ in texts]
    if params is None:
        return out
    owners, windows, all_starts = [], [], []
    for number, text in enumerate(texts):
        starts = _window_starts(text)
        if starts:
            owners.append(number)
            all_starts.append(starts)
            windows.append(_window_classes(tagger.char_classes(text), starts))
    if not owners:
        return out
    flat = np.concatenate(windows)
    scores = np.concatenate([tagger.emissions(flat[i : i + 2048], params) for i in range(0, len(flat), 2048)])
    runs, at = [], 0
    for number, starts in zip(owners, all_starts, strict=True):
        for begin, merged in _merged(scores[at : at + len(starts)], starts, len(texts[number])):
            runs.append((number, begin, merged))
        at += len(starts)
    paths = tagger.best_tags([r[2] for r in runs], params["move"])
    for (number, begin, _), path in zip(runs, paths, strict=True):
        taken = base[number]
        for span in _spans_of(path, begin, texts[number]):
            if not any(span[0] < b and a < span[1] for a, b, _ in taken):
                out[number].append(span)
    return out


def find(texts: list[str], params: tagger.Params | None) -> list[tuple[list[Span], list[Span]]]:
    base = [base_spans(t) for t in texts]
    return list(zip(base, added_spans(texts, base, params), strict=True))


def _structs(spans: list[Span]) -> list[dict]:
    return [{"kind": kind, "start": a, "end": b} for a, b, kind in spans]


def pii_spans(text: Column, model: PiiModel) -> Column:
    """``base`` and ``added`` spans of a text in code points; null where nothing can be."""

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        found = find([t or "" for t in texts], model.params)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        sides = [pa.array([_structs(f[side]) for f in found], kind) for side in (0, 1)]
        return pa.StructArray.from_arrays(sides, ["base", "added"])

    return run(F.when(text.rlike(TRIGGER), text))


def redacted(text: Column, model: PiiModel) -> Column:
    """The text with every span replaced by its kind in angle brackets; null stays null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        out = []
        for t, (base, added) in zip(texts, find([t or "" for t in texts], model.params), strict=True):
            pieces, done = [], 0
            for begin, end, kind in sorted([*base, *added], key=lambda s: (s[0], -s[1])):
                if begin >= done:
                    pieces += [t[done:begin], f"<{kind.upper()}>"]
                done = max(done, end)
            out.append(None if t is None else "".join([*pieces, t[done:]]))
        return pa.array(out, pa.string())

    return F.coalesce(run(F.when(text.rlike(TRIGGER), text)), text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, model: PiiModel) -> DataFrame:
    """Per row ``doc_id, base, added``: arrays of (kind, start, end).

    Base spans stand by start and kind, added ones by start. Null texts are empty
    texts; those have no spans. Repeated rows give repeated rows.
    """
    bound_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pii_spans(F.col("text"), model).alias("s"))
    none = F.array().cast(SPANS)
    return found.select("doc_id", *[F.coalesce(f"s.{side}", none).alias(side) for side in ("base", "added")])


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined forms of ``personal_data``."""
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.transform(
        F.array_sort(
            F.transform(
                F.concat("base", "added"),
                lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"),
                                   s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    counts = [_count(F.col("base"), kind).alias(f"n_{kind}") for kind in KINDS]
    base = F.sha2(_joined(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _joined(every).alias("spans"))
