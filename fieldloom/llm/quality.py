"""Quality of texts by naive-Bayes support vectors.

Features are indicators: which byte n-grams a text holds, and which n-grams of word
shapes (case, ending, length, whether a word repeats the one before). Each is scaled
by the log-count ratio of the classes; a linear hinge-loss model is fitted on the
scaled, normalised indicators by dual coordinate descent. Margins become scores by a
logistic curve, fitted on margins of rows that the model did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.arrays import Words, bound_batches
from fieldloom.llm.samples import labelled_sample

#: Bytes of the byte n-grams, and bits of their hashed places.
GRAM = 4
GRAM_BITS = 18
SHAPES = 64
SIZE = (1 << GRAM_BITS) + SHAPES + SHAPES**2 + SHAPES**3
#: Labelled rows, as a mean, that the model is fitted on.
FIT_ROWS = 6_000
EPOCHS = 12
COST = 1.0
GOOD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """``ratios``: log-count ratios; ``weights``: per scaled indicator; the curve's two numbers."""

    ratios: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float


def word_shapes(words: Words) -> np.ndarray:
    """A number under ``SHAPES`` for each word."""
    if not len(words.starts):
        return np.empty(0, np.int64)
    first, last = words.raw[words.starts], words.raw[words.ends - 1]
    before_last = words.raw[np.maximum(words.ends - 2, words.starts)]
    upper = (first >= 65) & (first <= 90)
    mid = words.raw[np.minimum(words.starts + 1, words.ends - 1)]
    loud = upper & (mid >= 65) & (mid <= 90)
    letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    stop = np.isin(last, np.frombuffer(b".,;:?!", np.uint8))
    ending = np.where(letter, 0, np.where(stop & (before_last != last), 1, np.where(before_last == last, 2, 3)))
    repeats = np.zeros(len(last), bool)
    repeats[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text_of[1:] == words.text_of[:-1])
    single = words.ends - words.starts == 1
    return (ending + 4 * upper + 8 * loud + 16 * repeats + 32 * single).astype(np.int64)


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted places of its features."""
    words = Words(column)
    shapes = word_shapes(words)
    for text in range(len(column)):
        raw = words.raw[words.offsets[text] : words.offsets[text + 1]].astype(np.uint32)
        parts = []
        if len(raw) >= GRAM:
            code = np.zeros(len(raw) - GRAM + 1, np.uint32)
            for j in range(GRAM):
                code |= raw[j : len(raw) - GRAM + 1 + j] << np.uint32(8 * j)
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x9E3779B1)
            parts.append((code >> np.uint32(32 - GRAM_BITS)).astype(np.int64))
        own = shapes[words.first[text] : words.first[text + 1]]
        base, code = 1 << GRAM_BITS, np.zeros(len(own), np.int64)
        for n in range(1, 4):
            if len(own) < n:
                break
            code = code[: len(own) - n + 1] * SHAPES + own[n - 1 :]
            parts.append(base + code)
            base += SHAPES**n
        seen = np.zeros(SIZE, bool) if sum(map(len, parts)) > SIZE else None
        if seen is None:
            yield np.unique(np.concatenate([np.empty(0, np.int64), *parts]))
        else:
            for part in parts:
                seen[part] = True
            yield np.flatnonzero(seen)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [p.astype(np.int32) for p in indicators(batch.column("text"))]
        ends = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *places])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
            ["doc_id", "label", "places"],
        )


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SIZE))
    for places, label in zip(rows, good, strict=True):
        counts[int(label), places] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit_hinge(rows: list[np.ndarray], ratios: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights of the squared hinge loss by dual coordinate descent; classes count alike."""
    sign = np.where(good, 1.0, -1.0)
    share = good.mean()
    cost = COST * np.where(good, 0.5 / share, 0.5 / (1 - share))
    values = [ratios[p] for p in rows]
    values = [v / max(1e-12, np.sqrt((v**2).sum())) for v in values]
    weights, dual = np.zeros(SIZE), np.zeros(len(rows))
    ridge = 0.5 / cost
    diagonal = np.array([(v**2).sum() for v in values]) + ridge
    rng = np.random.default_rng(8)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] * values[i]).sum() - 1 + ridge[i] * dual[i]
            new = max(0.0, dual[i] - slope / diagonal[i])
            if new != dual[i]:
                weights[rows[i]] += (new - dual[i]) * sign[i] * values[i]
                dual[i] = new
    return weights


def margins(rows: list[np.ndarray], ratios: np.ndarray, weights: np.ndarray) -> np.ndarray:
    scaled, length = weights * ratios, ratios**2
    return np.array([scaled[p].sum() / max(1e-12, np.sqrt(length[p].sum())) for p in rows])


def fit_curve(x: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with softened targets."""
    n_good, n_bad = good.sum(), (~good).sum()
    target = np.where(good, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    both = np.stack([x, np.ones_like(x)], axis=1)
    params = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(both @ params, -30, 30)))
        gradient = both.T @ (p - target) + 1e-3 * params
        hessian = (both * (p * (1 - p))[:, None]).T @ both + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        params = params - step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
    return float(params[0]), float(params[1])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel:
    """A model from ``labels (doc_id, quality)`` of about ``rows`` labelled texts.

    Without rows of both classes every score is the share of good rows, and 0.5
    without any.
    """
    bound_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", rows)
    table = sample.mapInArrow(_collected, "doc_id long, label int, places array<int>").toArrow()
    order = np.lexsort((table["label"].to_numpy(), table["doc_id"].to_numpy()))
    good = table["label"].to_numpy()[order] > 0
    lists = table["places"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    found = [flat[ends[i] : ends[i + 1]] for i in order]
    if not good.any() or good.all():
        share = good.mean() if len(good) else 0.5
        offset = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30))
        return QualityModel(np.zeros(SIZE), np.zeros(SIZE), 0.0, offset)
    half = np.arange(len(found)) % 2 == 0
    unseen = np.zeros(len(found))
    for side in (half, ~half):
        train, other = np.flatnonzero(side), np.flatnonzero(~side)
        labels_of = good[train]
        if not labels_of.any() or labels_of.all() or not len(other):
            continue
        own = [found[i] for i in train]
        ratios = log_count_ratios(own, labels_of)
        unseen[other] = margins([found[i] for i in other], ratios, fit_hinge(own, ratios, labels_of))
    ratios = log_count_ratios(found, good)
    weights = fit_hinge(found, ratios, good)
    slope, offset = fit_curve(unseen, good)
    return QualityModel(ratios, weights, slope, offset)


def quality(text: Column, model: QualityModel) -> Column:
    """A score from 0 to 1; null texts are empty texts, which have a score as well."""
    scaled = (model.weights * model.ratios).astype(np.float32)
    length = (model.ratios**2).astype(np.float32)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        x = np.array(
            [scaled[p].sum(dtype=float) / max(1e-12, length[p].sum(dtype=float) ** 0.5) for p in indicators(column)]
        )
        return pa.array(1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30))), pa.float64())

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learned from; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; repeated rows give repeated rows.

    Takes ``doc_id`` and ``text``, whatever else there is.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality(F.col("text"), model).alias("score"))
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
