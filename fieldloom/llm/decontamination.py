"""Benchmark passages in texts, found by latent semantic retrieval.

Texts are read as passages of ``WINDOW`` words, one every ``STRIDE``. A passage is a
TF-IDF vector over the words of the benchmark; document frequencies come from all
texts but for the surroundings of quotes, so that a frequent leak does not make its own
words common, and their logarithms count to a power, as words that are everywhere say
nothing here. A randomised SVD of the passages of all texts (range finder with power steps
on the products of their terms, which Spark sums in one pass) gives a latent space; a passage is a candidate if its cosine with a benchmark passage
is high enough and it holds enough of that passage's weight. So is every passage with
``GRAM`` words in a row of an item, and, for items of which too few words are weighty,
every passage with enough of the item's rarest words, which loses none that the check
would take. The longest common subsequence of words between the benchmark item
and the text around the passage decides, for near misses together with the answer,
the last sentence of the item.

The benchmark is the stated query set. It is taken in blocks of ``BLOCK_ITEMS``
items, so the model sent to the executors has a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.arrays import Words, bound_batches
from fieldloom.llm.toxicity import Lookup
from fieldloom.session import written

WINDOW = 32
STRIDE = 16
#: Items with fewer words are looked for as a phrase, word for word; those with fewer
#: than ``GRAM`` words say too little to tell a leak from chance.
ITEM_WORDS = 8
BLOCK_ITEMS = 1_000
IDF_POWER = 3
#: Dimensions of the latent space, and extra ones of the range finder.
LATENT = 192
OVERSAMPLE = 16
POWER_STEPS = 2
#: Tasks that multiply the products of terms by a matrix, and products that a task holds before it adds them up.
FIT_PARTITIONS = 4
HELD_PRODUCTS = 1 << 20
COSINE = 0.5
#: Part of a benchmark passage's vector that a candidate must cover.
COVER = 0.15
#: Words in more than one of so many texts, and in two or more, have no weight (they
#: count in the check).
COMMON_TEXTS = 10
#: Words in a row of an item that make a quote of it.
GRAM = 4
#: Items with a smaller weighty part are searched for by all places of its words; with
#: half of that or less, so many of the item's rarest words count as weighty.
LEAST_WEIGHTY = 1 / 3
#: Share of an item's words in common order that makes a leak, and a paraphrase of it;
#: and of its weighty words alone, since common words are in order anywhere.
COMMON = 0.6
WEIGHTY = 0.5
PARAPHRASE = 0.5
ANSWER = 0.8

FOUND = "array<struct<item_id:long,share:double,first_word:long>>"


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[int, ...]
    answer: tuple[int, ...]


@dataclass(frozen=True)
class LeakModel:
    """Everything a task needs to test texts against one block of the benchmark."""

    keys: np.ndarray
    idf: np.ndarray
    projection: np.ndarray
    latent_items: np.ndarray
    item_of: np.ndarray
    items: list[Item]
    #: Of all words, common ones too.
    rarity: np.ndarray | None = None
    #: Sorted word groups of the items, and whose they are.
    grams: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    gram_item: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


@dataclass(frozen=True)
class PhraseModel:
    """Short items: per number of words the sorted hashes of the phrases, and whose they are."""

    phrases: dict[int, tuple[np.ndarray, np.ndarray]]


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one machine step per word.

    ``masks``: for each word of the item the bits of its places.
    """
    full = (1 << length) - 1
    row = full
    for word in words:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def places(words: tuple[int, ...]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


def _weighty(at: np.ndarray, place: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = idf[place] > 0
    return at[keep], place[keep]


def _stretches(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of ``STRIDE`` words that each known word is in, and each text's first one."""
    first = np.concatenate(([0], np.cumsum(-(-words.counts // STRIDE))))
    text = words.text_of[at]
    return first[text] + (at - words.first[text]) // STRIDE, first


def _followed(first: np.ndarray) -> np.ndarray:
    """Which stretches have a next one in their text; a window is a stretch and the next."""
    out = np.ones(first[-1], bool)
    out[(first[1:] - 1)[np.diff(first) > 0]] = False
    return out


def _latent(windows: np.ndarray, block: np.ndarray, place: np.ndarray, first: np.ndarray, projection: np.ndarray):
    """The latent vectors of some windows."""
    followed = _followed(first)
    wanted = np.zeros(len(followed) + 1, bool)
    wanted[windows] = True
    wanted[windows[followed[windows]] + 1] = True
    row_of = np.cumsum(wanted) - 1
    used = wanted[block]
    rows, known = row_of[block[used]], place[used]
    sums = np.zeros((int(wanted.sum()) + 1, projection.shape[1]), np.float32)
    if len(rows):
        new = np.concatenate(([True], rows[1:] != rows[:-1]))
        rank = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        # A stretch has at most STRIDE words: add up all first ones, all second ones ...
        for turn in range(int(rank.max()) + 1):
            now = rank == turn
            sums[rows[now]] += projection[known[now]]
    out = sums[row_of[windows]]
    more = followed[windows]
    out[more] += sums[row_of[windows[more] + 1]]
    return out


def _sparse_passages(words: Words, lookup: Lookup, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Normalised TF-IDF passages as (row, term, value) and the number of rows."""
    at, place = _weighty(*lookup.found(words.hashes), idf)
    block, first = _stretches(words, at)
    # A word belongs to the window that starts in its stretch and to the one before.
    earlier = block > first[words.text_of[at]]
    row, term = np.concatenate([block, block[earlier] - 1]), np.concatenate([place, place[earlier]])
    pair, counts = np.unique(row * len(idf) + term, return_counts=True)
    row, term = pair // max(1, len(idf)), pair % max(1, len(idf))
    value = counts * idf[term]
    norm = np.sqrt(np.bincount(row, value**2, first[-1]))
    return row, term, value / np.maximum(norm[row], 1e-12), int(first[-1])


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, right: np.ndarray) -> np.ndarray:
    """``A @ right`` for the sparse ``A``."""
    out = np.zeros((n, right.shape[1]), right.dtype)
    if len(row):
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[begins]] = np.add.reduceat(value[:, None].astype(right.dtype) * right[term], begins, axis=0)
    return out


def _turned(row: np.ndarray, term: np.ndarray, value: np.ndarray, terms: int, left: np.ndarray) -> np.ndarray:
    """``A.T @ left``."""
    order = np.argsort(term, kind="stable")
    return _times(term[order], row[order], value[order], terms, left)


def _document_counts(lookup: Lookup, grams: Lookup):
    """Texts that hold each word farther than ``WINDOW`` from quotes; -1: texts with words there or no quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(len(lookup.keys), np.int64), 0
        for batch in batches:
            words = Words(batch.column("text"))
            hashes, begins = words.groups(GRAM)
            hits = begins[grams.found(hashes)[0]]
            text = words.text_of[hits]
            near = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(near, np.maximum(words.first[text], hits - WINDOW), 1)
            np.add.at(near, np.minimum(words.first[text + 1], hits + GRAM + WINDOW), -1)
            apart = np.cumsum(near[:-1]) == 0
            whole = np.ones(batch.num_rows, bool)
            whole[text] = False
            whole[words.text_of[apart]] = True
            at, place = lookup.found(words.hashes)
            counted = apart[at]
            pairs = np.unique(words.text_of[at[counted]] * max(1, len(lookup.keys)) + place[counted])
            total += np.bincount(pairs % max(1, len(lookup.keys)), minlength=len(lookup.keys))
            texts += int(whole.sum())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], texts))], ["term", "copies"]
        )

    return run


def _products(lookup: Lookup, idf: np.ndarray):
    """The upper half of ``A.T A`` in parts, ``A`` the passages; term -1: their number."""
    terms = len(idf)

    def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        return pairs, np.bincount(at, np.concatenate(values), len(pairs))

    def table(pairs: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(pairs // max(1, terms), pa.int64()), pa.array(pairs % max(1, terms), pa.int64()), pa.array(values, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["one", "other", "product"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held, rows = [np.empty(0, np.int64)], [np.empty(0)], 0, 0
        for batch in batches:
            row, term, value, n = _sparse_passages(Words(batch.column("text")), lookup, idf)
            rows += n
            for step in range(len(row)):
                at = np.flatnonzero(row[: len(row) - step] == row[step:])
                if not len(at):
                    break
                keys.append(term[at] * terms + term[at + step])
                values.append(value[at] * value[at + step])
                held += len(at)
            if held >= HELD_PRODUCTS:
                pairs, sums = summed(keys, values)
                if len(pairs) >= HELD_PRODUCTS // 2:
                    yield table(pairs, sums)
                    pairs, sums = pairs[:0], sums[:0]
                keys, values, held = [pairs], [sums], len(pairs)
        yield table(*summed(keys, values))
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1]), pa.array([float(rows)])], ["one", "other", "product"])

    return run


def passage_products(texts: DataFrame, lookup: Lookup, idf: np.ndarray) -> tuple[DataFrame, float]:
    """``one, other, product``: products of two terms over all passages, ``one <= other``, and the number of passages."""
    parts = texts.select("text").mapInArrow(_products(lookup, idf), "one long, other long, product double")
    found = written(parts.groupBy("one", "other").agg(F.sum("product").alias("product")), "term-products")
    rows = found.filter("one < 0").agg(F.coalesce(F.sum("product"), F.lit(0.0))).first()[0]
    return found.filter("one >= 0"), rows


def _multiplied(right: np.ndarray):
    """Per partition of the products of terms its part of ``A.T (A right)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(right.shape, np.float32)
        for batch in batches:
            one, other, product = (batch.column(n).to_numpy() for n in ("one", "other", "product"))
            apart = one != other
            row, term = np.concatenate([one, other[apart]]), np.concatenate([other, one[apart]])
            order = np.argsort(row, kind="stable")
            own, at = np.unique(row, return_inverse=True)
            value = np.concatenate([product, product[apart]])[order]
            total[own] += _times(at[order], term[order], value, len(own), right)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    return run


def latent_space(texts: DataFrame, benchmark: pa.Array, lookup: Lookup, idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passages, a column each."""
    terms = len(idf)
    width = min(LATENT + OVERSAMPLE, terms)
    own = _sparse_passages(Words(benchmark), lookup, idf)
    products, rows = passage_products(texts, lookup, idf)

    def multiplied(right: np.ndarray) -> np.ndarray:
        # One array of bounded size from each of FIT_PARTITIONS partitions.
        right = right.astype(np.float32)
        parts = products.coalesce(FIT_PARTITIONS).mapInArrow(_multiplied(right), "total binary").collect()
        # Both sides carry the same weight, however many passages each has.
        total = _turned(*own[:3], terms, _times(*own, right)) * max(1.0, rows / max(1, own[3]))
        for part in parts:
            total = total + np.frombuffer(part["total"], np.float32).reshape(total.shape)
        return total

    basis = np.random.default_rng(5).standard_normal((terms, width))
    for _ in range(POWER_STEPS):
        basis, _ = np.linalg.qr(multiplied(basis))
    spread = basis.T @ multiplied(basis)
    values, turn = np.linalg.eigh((spread + spread.T) / 2)
    leading = np.argsort(values)[::-1][: min(LATENT, width)]
    return basis @ turn[:, leading]


def _read_items(batch: pa.Array, ids: list[int]) -> list[Item]:
    words = Words(batch)
    out = []
    for i, item_id in enumerate(ids):
        begin, end = words.first[i], words.first[i + 1]
        own = tuple(words.hashes[begin:end].tolist())
        closes = [j for j in range(begin, end - 1) if words.raw[words.ends[j] - 1] in b".?!"]
        answer = own[closes[-1] + 1 - begin :] if closes else own[-max(1, len(own) // 4) :]
        out.append(Item(item_id, own, answer))
    return out


def fit_leaks(docs: DataFrame, benchmark: DataFrame) -> list[LeakModel | PhraseModel]:
    """One model per block of the benchmark (``item_id, text``), and one of its short items.

    Items without an id or with fewer than ``GRAM`` words are left out.
    """
    bound_batches(docs.sparkSession)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna().distinct()
    blocks = max(1, -(-named.count() // BLOCK_ITEMS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    models = []
    for block in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.orderBy("item_id", "text").collect()
        column = pa.array([r["text"] for r in rows], pa.string())
        items = _read_items(column, [r["item_id"] for r in rows])
        long = [len(item.words) >= ITEM_WORDS for item in items]
        short = [GRAM <= len(item.words) < ITEM_WORDS for item in items]
        if any(short):
            models.append(_phrases([i for i, ok in zip(items, short, strict=True) if ok], column.filter(pa.array(short))))
        items, column = [i for i, ok in zip(items, long, strict=True) if ok], column.filter(pa.array(long, pa.bool_()))
        if not items:
            continue
        keys = np.unique(np.array([w for item in items for w in item.words], np.uint64))
        lookup = Lookup(keys)
        words = Words(column)
        grams, begins = words.groups(GRAM)
        gram_order = np.argsort(grams, kind="stable")
        grams, gram_item = grams[gram_order], words.text_of[begins[gram_order]]
        counter = _document_counts(lookup, Lookup(np.unique(grams)))
        counted = texts.select("text").mapInArrow(counter, "term long, copies long")
        counts = dict(counted.groupBy("term").agg(F.sum("copies")).collect())
        total = counts.pop(-1, 0)
        copies = np.zeros(len(keys))
        copies[list(counts)] = list(counts.values())
        rarity = np.log((total + len(items) + 1) / (copies + 1))
        idf = np.where(copies * COMMON_TEXTS <= max(total, COMMON_TEXTS), rarity, 0.0) ** IDF_POWER
        space = latent_space(texts, column, lookup, idf)
        projection = (idf[:, None] * space).astype(np.float32)
        at, place = _weighty(*lookup.found(words.hashes), idf)
        block, first = _stretches(words, at)
        # The window at an item's last stretch is part of the one before.
        windows = np.flatnonzero(_followed(first) | np.isin(np.arange(first[-1]), first[:-1]))
        latent = _latent(windows, block, place, first, projection)
        item_of = np.searchsorted(first, windows, "right") - 1
        known = np.linalg.norm(latent, axis=1) > 0
        models.append(
            LeakModel(keys, idf, projection, latent[known], item_of[known], items, rarity, grams, gram_item)
        )
    return models


def _quoted(words: Words, first: np.ndarray, grams: Lookup, model: LeakModel) -> tuple[np.ndarray, np.ndarray]:
    """Windows, and the items of which they hold ``GRAM`` words in a row."""
    hashes, begins = words.groups(GRAM)
    at, _ = grams.found(hashes)
    low, high = (np.searchsorted(model.grams, hashes[at], side) for side in ("left", "right"))
    begin = np.repeat(begins[at], high - low)
    turn = np.arange(len(begin)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    text = words.text_of[begin]
    return first[text] + (begin - words.first[text]) // STRIDE, model.gram_item[np.repeat(low, high - low) + turn]


def _holding(words: Words, first: np.ndarray, at: np.ndarray, least: int, size: int) -> np.ndarray:
    """Windows around which the check of an item of ``size`` words sees ``least`` of the places ``at``."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = words.first[text] + (np.arange(first[-1]) - first[text]) * STRIDE
    low = np.maximum(words.first[text], begin - size)
    high = np.minimum(words.first[text + 1], begin + WINDOW + size)
    return np.flatnonzero(np.searchsorted(at, high) - np.searchsorted(at, low) >= least)


def _found_in(model: LeakModel):
    lookup = Lookup(model.keys)
    masks = [places(item.words) for item in model.items]
    answers = [places(item.answer) for item in model.items]
    weighty_words = set(model.keys[model.idf > 0].tolist())
    weighty = [tuple(w for w in item.words if w in weighty_words) for item in model.items]
    rarity = model.idf if model.rarity is None else model.rarity
    poor: dict[int, np.ndarray] = {}
    for number, item in enumerate(model.items):
        if len(weighty[number]) < LEAST_WEIGHTY * len(item.words):
            place = np.searchsorted(model.keys, np.array(item.words, np.uint64))
            heavy = model.idf[place] > 0
            if heavy.sum() <= LEAST_WEIGHTY / 2 * len(place):
                # Whole words, all as rare as the last one that is needed.
                heavy = rarity[place] >= np.sort(rarity[place])[::-1][int(np.ceil(LEAST_WEIGHTY * len(place))) - 1]
            weighty[number] = tuple(w for w, is_heavy in zip(item.words, heavy, strict=True) if is_heavy)
            poor[number] = np.unique(place[heavy])
    grams = Lookup(np.unique(model.grams))
    weighty_masks = [places(words) for words in weighty]
    norms = np.linalg.norm(model.latent_items, axis=1)
    turned = np.ascontiguousarray((model.latent_items / norms[:, None]).T)
    # Turning into the latent space makes no vector longer.
    least = COVER * norms.min() if len(norms) else np.inf

    def leaks(column: pa.Array) -> list[list[dict]]:
        words = Words(column)
        at, known = lookup.found(words.hashes)
        heavy, place = _weighty(at, known, model.idf)
        block, first = _stretches(words, heavy)
        followed = _followed(first)
        # The length of each stretch's vector; a window is no longer than its two together.
        pair, times = np.unique(block * max(1, len(model.idf)) + place, return_counts=True)
        weight = (times * model.idf[pair % max(1, len(model.idf))]) ** 2
        length = np.sqrt(np.bincount(pair // max(1, len(model.idf)), weight, first[-1]))
        length[np.flatnonzero(followed)] += length[np.flatnonzero(followed) + 1]
        rich = np.flatnonzero(length >= least)
        latent = _latent(rich, block, place, first, model.projection)
        length = np.linalg.norm(latent, axis=1)
        close = latent @ turned
        passage, query = np.nonzero((close >= COSINE * length[:, None]) & (close >= COVER * norms))
        item = model.item_of[query]
        quoting, quoted = _quoted(words, first, grams, model)
        windows, numbers = [rich[passage], quoting], [item, quoted]
        for number, terms in poor.items():
            of_item = np.zeros(len(model.keys), bool)
            of_item[terms] = True
            own, least_heavy = at[of_item[known]], max(1, int(np.ceil(WEIGHTY * len(weighty[number]))))
            if len(own) >= least_heavy:
                windows.append(_holding(words, first, own, least_heavy, len(model.items[number].words)))
                numbers.append(np.full(len(windows[-1]), number))
        window_of, item = np.concatenate(windows), np.concatenate(numbers)
        text_of = np.searchsorted(first, window_of, "right") - 1
        out: list[list[dict]] = [[] for _ in range(len(column))]
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for text, number, window in sorted(set(zip(text_of.tolist(), item.tolist(), window_of.tolist(), strict=True))):
            own = model.items[number]
            size = len(own.words)
            begin = words.first[text] + (window - first[text]) * STRIDE
            low, high = max(words.first[text], begin - size), min(words.first[text + 1], begin + WINDOW + size)
            seen = words.hashes[at[np.searchsorted(at, low) : np.searchsorted(at, high)]].tolist()
            share = common_subsequence(masks[number], size, seen) / size
            if share < PARAPHRASE:
                continue
            heavy_size = len(weighty[number])
            if common_subsequence(weighty_masks[number], heavy_size, seen) < WEIGHTY * heavy_size:
                continue
            if share < COMMON:
                answer = len(own.answer)
                if common_subsequence(answers[number], answer, seen) < ANSWER * answer:
                    continue
            place_in_text = int(begin - words.first[text])
            before = best.get((text, number))
            if before is None or share > before[0]:
                best[text, number] = (share, place_in_text)
        for (text, number), (share, begin) in sorted(best.items()):
            out[text].append({"item_id": model.items[number].item_id, "share": share, "first_word": begin})
        return out

    return leaks


def _phrases(items: list[Item], column: pa.Array) -> PhraseModel:
    """The short items of a block, each as the hash of all its words."""
    words, out = Words(column), {}
    for size in sorted({len(item.words) for item in items}):
        hashes, begins = words.groups(size)
        own = [i for i, item in enumerate(items) if len(item.words) == size]
        marks = hashes[np.searchsorted(begins, words.first[own])]
        order = np.argsort(marks, kind="stable")
        out[size] = (marks[order], np.array([items[i].item_id for i in own])[order])
    return PhraseModel(out)


def _holding_phrases(model: PhraseModel):
    def leaks(column: pa.Array) -> list[list[dict]]:
        words = Words(column)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for size, (marks, ids) in model.phrases.items():
            hashes, begins = words.groups(size)
            low, high = (np.searchsorted(marks, hashes, side) for side in ("left", "right"))
            seen = set()
            for at in np.flatnonzero(high > low):
                text = int(words.text_of[begins[at]])
                for item_id in ids[low[at] : high[at]].tolist():
                    if (text, item_id) not in seen:
                        seen.add((text, item_id))
                        first_word = int(begins[at] - words.first[text])
                        out[text].append({"item_id": item_id, "share": 1.0, "first_word": first_word})
        return out

    return leaks


def leaks(text: Column, models: list[LeakModel | PhraseModel]) -> Column:
    """The benchmark items found in a text, as an array; null and empty texts hold none."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("first_word", pa.int64())]))

    def tested(model: LeakModel | PhraseModel) -> Column:
        found = _holding_phrases(model) if isinstance(model, PhraseModel) else _found_in(model)

        @F.arrow_udf(FOUND)
        def run(column: pa.Array) -> pa.Array:
            return pa.array(found(column), kind)

        return run(text)

    if not models:
        return F.array().cast(FOUND)
    return F.concat(*[tested(model) for model in models])


def contaminated(docs: DataFrame, models: list[LeakModel | PhraseModel]) -> DataFrame:
    """``doc_id, item_id, share, first_word``: one row per text and benchmark item in it.

    ``share`` is the part of the item's words found in order, ``first_word`` where the
    passage begins that shows most. Takes ``doc_id`` and ``text``, whatever else there
    is. Repeated rows give repeated rows; without benchmark items there are no rows.
    """
    bound_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(leaks(F.col("text"), models)).alias("f"))
    return found.select("doc_id", "f.item_id", "f.share", "f.first_word")


def without_leaks(docs: DataFrame, models: list[LeakModel | PhraseModel]) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns."""
    bound_batches(docs.sparkSession)
    return docs.filter(F.size(leaks(docs["text"], models)) == 0)
