"""Severity of toxic language by cumulative-link ordinal regression.

Grades 0 to 3 share one weight per text feature and differ by ordered thresholds:
``P(grade > k) = sigmoid(w.x - t_k)`` with ``t_0 < t_1 < t_2``. Features are the
presence of words and of beginnings of words, taken by 64-bit hashes, so that no two
features share a weight. Only features whose counts in clean and toxic training texts
differ clearly (a likelihood-ratio test) get a weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.arrays import Words, bound_batches, mixed
from fieldloom.llm.samples import SAMPLE_ROWS, labelled_sample

#: Bytes of the word beginnings that are features of their own.
PREFIXES = (4, 5)
GRADES = 3
#: Likelihood ratio (twice the log) from which a feature tells the classes apart.
LIKELIHOOD_RATIO = 12.0
#: Most features the model holds, those with the greatest ratio; a bound of its size.
FEATURES = 20_000
STEPS = 400
PENALTY = 1e-3
THRESHOLD = 0.5

RESULT = "severity double, probability double, grade int, toxic boolean"


@dataclass(frozen=True)
class ToxicityModel:
    """``keys``: sorted feature hashes; ``thresholds``: ascending."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The feature hashes of all words, and the text of each."""
    words = Words(column, letters=True, prefixes=PREFIXES)
    salted = [mixed(p ^ np.uint64(n)) for n, p in zip(PREFIXES, words.prefixes, strict=True)]
    return np.concatenate([words.hashes, *salted]), np.tile(words.text_of, 1 + len(PREFIXES))


class Lookup:
    """Positions of hashes among sorted keys. A table of leading bits sorts most out."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.leading = np.zeros(1 << 16, bool)
        self.leading[(keys >> np.uint64(48)).astype(np.int64)] = True

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys, and which keys they are."""
        at = np.flatnonzero(self.leading[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.searchsorted(self.keys, hashes[at])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == hashes[at] if len(self.keys) else np.zeros(0, bool)
        return at[hit], place[hit]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per feature, of each class, within a batch."""
    for batch in batches:
        hashes, text_of = text_features(batch.column("text"))
        toxic = batch.column("label").to_numpy(zero_copy_only=False) > 0
        order = np.lexsort((text_of, hashes))
        hashes, text_of = hashes[order], text_of[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
        hashes, text_of = hashes[new], text_of[new]
        keys, inverse = np.unique(hashes, return_inverse=True)
        bad = np.bincount(inverse, toxic[text_of], len(keys)).astype(np.int64)
        all_texts = np.bincount(inverse, minlength=len(keys))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(bad), pa.array(all_texts - bad)], ["feature", "bad", "good"]
        )


def _present(keys: np.ndarray):
    lookup = Lookup(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, text_of = text_features(batch.column("text"))
            at, place = lookup.found(hashes)
            pairs = np.unique(text_of[at].astype(np.int64) * max(1, len(keys)) + place)
            texts, places = pairs // max(1, len(keys)), pairs % max(1, len(keys))
            ends = np.searchsorted(texts, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(places.astype(np.int32)))],
                ["label", "present"],
            )

    return run


def _log_ratio_test(bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """Twice the log likelihood ratio that a feature's texts fall on the classes by chance."""
    total = bad + good
    share = n_bad / (n_bad + n_good)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    return 2 * (part(bad, total * share) + part(good, total * (1 - share)))


def fit_thresholds(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, start: np.ndarray) -> tuple:
    """Weights and ordered thresholds by full-batch gradient steps (Adam).

    ``rows, columns``: the texts and features of the non-zero entries.
    """
    n = len(grades)
    counts = np.array([(grades > k).mean() for k in range(GRADES)]).clip(0.5 / n, 1 - 0.5 / n)
    first = -np.log(counts[0] / (1 - counts[0])) + 2.0
    # Thresholds as a first one and positive gaps.
    params = np.concatenate([start, [first], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    above = grades[:, None] > np.arange(GRADES)[None, :]
    at = (grades[:, None] == np.arange(GRADES)) | (grades[:, None] == np.arange(1, GRADES + 1))
    f = len(start)
    for step in range(1, STEPS + 1):
        w, gaps = params[:f], np.log1p(np.exp(params[f + 1 :]))
        thresholds = params[f] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[columns], n)
        q = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -30, 30)))
        bounds = np.concatenate([np.ones((n, 1)), q, np.zeros((n, 1))], axis=1)
        p = np.maximum(bounds[np.arange(n), grades] - bounds[np.arange(n), grades + 1], 1e-9)
        slope = q * (1 - q) * np.where(above, 1.0, -1.0) * at / p[:, None]
        d_score = slope.sum(axis=1)
        d_thresholds = -slope.sum(axis=0)
        gradient = np.empty_like(params)
        gradient[:f] = -np.bincount(columns, d_score[rows], f) / n + PENALTY * w / max(1, f) ** 0.5
        gradient[f] = -d_thresholds.sum() / n
        tails = np.cumsum(d_thresholds[::-1])[::-1][1:]
        gradient[f + 1 :] = -tails / n / (1 + np.exp(-params[f + 1 :]))
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.log1p(np.exp(params[f + 1 :]))
    return params[:f], params[f] + np.concatenate([[0.0], np.cumsum(gaps)])


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from ``labels.toxic`` of about ``rows`` labelled texts.

    Labels above 1 are grades. Where labels tell only 0 and 1, toxic rows are graded
    by how many different telling features they hold: up to the first third of toxic
    rows 1, up to the second 2, beyond 3. Without rows of both classes the model
    finds nothing toxic.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sample = labelled_sample(docs, labels, "toxic", rows)
    sizes = dict(sample.groupBy((F.col("label") > 0).alias("bad")).count().collect())
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    if not n_bad or not n_good:
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), np.arange(1.0, GRADES + 1) * 10)
    counts = sample.select("label", "text").mapInArrow(_counts, "feature long, bad long, good long")
    counts = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = _log_ratio_test(F.col("bad"), F.col("good"), n_bad, n_good)
    telling = (
        counts.withColumn("ratio", ratio)
        .filter((F.col("bad") * n_good > F.col("good") * n_bad) & (F.col("ratio") >= LIKELIHOOD_RATIO))
        .orderBy(F.desc("ratio"), "feature")
        .limit(FEATURES)
        .toPandas()
    )
    keys = np.sort(telling["feature"].to_numpy(np.int64).view(np.uint64))
    seen = sample.select("label", "text").mapInArrow(_present(keys), "label int, present array<int>").toPandas()
    # The rows arrive in no fixed order; the fit sums over them.
    seen["present"] = seen["present"].map(tuple)
    seen = seen.sort_values(["label", "present"], kind="stable")
    label, present = seen["label"].to_numpy(), list(seen["present"])
    amount = np.array([len(p) for p in present])
    grades = np.minimum(label, GRADES)
    if label.max() <= 1:
        cuts = np.quantile(amount[label > 0], [1 / 3, 2 / 3])
        grades = np.where(label > 0, 1 + np.searchsorted(cuts, amount, "left"), 0)
    texts = np.repeat(np.arange(len(amount)), amount)
    columns = np.concatenate([np.array(p, np.int64) for p in present] or [np.empty(0, np.int64)])
    weights, thresholds = fit_thresholds(texts, columns, grades, np.ones(len(keys)))
    return ToxicityModel(keys, weights, thresholds)


def severity(text: Column, model: ToxicityModel) -> Column:
    """``severity`` (expected grade), ``probability`` of any, ``grade`` (likeliest), ``toxic``.

    Null and empty texts have no features and get the grade of those.
    """
    lookup = Lookup(model.keys)

    @F.arrow_udf(RESULT)
    def run(column: pa.Array) -> pa.Array:
        hashes, text_of = text_features(column)
        at, place = lookup.found(hashes)
        pairs = np.unique(text_of[at].astype(np.int64) * max(1, len(lookup.keys)) + place)
        texts, places = pairs // max(1, len(lookup.keys)), pairs % max(1, len(lookup.keys))
        score = np.bincount(texts, model.weights[places] if len(places) else None, len(column))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - model.thresholds, -500, 500)))
        bounds = np.concatenate([np.ones((len(column), 1)), above, np.zeros((len(column), 1))], axis=1)
        grade = (bounds[:, :-1] - bounds[:, 1:]).argmax(axis=1)
        fields = [above.sum(axis=1), above[:, 0], grade.astype(np.int32), above[:, 0] >= THRESHOLD]
        return pa.StructArray.from_arrays(
            [pa.array(f) for f in fields], ["severity", "probability", "grade", "toxic"]
        )

    return run(text)


def toxic_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, severity, probability, grade, toxic`` of every row of ``docs``.

    Takes ``doc_id`` and ``text``, whatever else there is. Null ids stay, repeated
    rows give repeated rows, an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity(F.col("text"), model).alias("s"))
    return scored.select("doc_id", "s.severity", "s.probability", "s.grade", "s.toxic")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns."""
    bound_batches(docs.sparkSession)
    return docs.filter(~severity(docs["text"], model)["toxic"])
