"""Passages that texts share, word for word or nearly, by collinear chaining.

Of equal texts one is searched; the others are rows with it. Seeds are the hashes of
``GROUP`` words in a row; of every ``SPREAD`` seeds in a row the smallest is kept, so two
equal stretches of ``GROUP + SPREAD - 1`` words keep the same seed. Seeds move once, to
tasks that read them in order and match the places of each: of at most ``FEW_TEXTS`` texts
all pairs, of more texts each place with the first one in the text with the smallest id
and in the one with the greatest. Those two hubs may share less of a passage than two
other texts do, so seeds of more texts are matched further as linked pairs: each with the
seed of the smallest hash in every window of ``WINDOWS`` words after it. A linked pair
survives replaced words between its ends. Seeds of few texts take part if two texts hold them
more than once, as a place meets only the first one in the other text, or if a pair of texts has
no second match: these are linked with all seeds of many texts around. All texts with a linked pair meet, however many
they are, but for those that hold the same ``CLASS_WORDS`` words in a row at the same
distance from it: these are a class, whose members meet its first text, and so are shown to
share those words. Stretches that repeat within
``PERIOD`` words may hold but one seed; their first and last places match with a reach. Inside long
stretches of one word no seed is kept. Where more than ``FEW_TEXTS`` texts have such stretches of a word, those of
``RUN_WORDS`` words and more are a class by that word, and all others are compared by the
words around them (``run_pairs``). The matches of a pair of texts are chained in order, with
a cost for gaps, by a Fenwick tree of prefix maxima. Each chain is then aligned on the
words: gaps by longest common subsequences, both ends by extension.

The passages with hubs are aligned first. Where two texts agree so well with one hub that they
must share a passage there (``implied``), their linked pairs do not meet: both are in a row
with the hub, and the link follows from these two rows.

Seeds that a bounded sample shows to be in very many texts are dealt to several tasks by
a hash of the text; the hubs of these parts are matched once more.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.arrays import Words, bound_batches, mixed, odd_constants
from fieldloom.llm.decontamination import common_subsequence, places
from fieldloom.llm.samples import taken
from fieldloom.session import written

#: Of two texts of 50 words with 10, 15, 20 and 25 % replaced at random that share a
#: passage, 99.9, 99.8, 99.7 and 99.1 % keep ``LEAST_SEEDS`` seeds in common (simulated).
GROUP = 4
SPREAD = 4
#: Texts with a seed, or with a near linked pair, up to which all their pairs meet.
FEW_TEXTS = 8
#: Words that a passage has at least, on both sides, and the share of them that agrees.
LEAST_WORDS = 45
AGREE = 0.75
#: Bounds of the windows of words from one seed to the other of linked pairs; the last seed of a passage
#: of ``LEAST_WORDS`` equal words begins before the last bound. Windows are narrow, so that a seed that
#: only one of two texts has seldom takes the place of one that both have.
WINDOWS = (4, 8, 12, 16, 20, 24, 28, 32, 36, LEAST_WORDS - GROUP + 1)
#: Words from which on linked pairs of more than ``FEW_TEXTS`` texts meet; nearer ones lie in one common line.
WIDE = 12
#: Words after which a stretch repeats, at most: kept seeds of such a stretch can all be one seed. And words
#: from its first and last seed to an equal one, a multiple of all these periods.
PERIOD = 4
AGAIN = 12
#: Equal words in a row that make a class of texts with a linked pair. With the words before
#: them, ``LEAST_WORDS`` in all, they are a passage of any two members.
CLASS_WORDS = 36
#: Cells of the table of places and texts that a task holds at once.
CELLS = 1 << 20
#: Texts of the sample that tells frequent seeds, and the texts of such a seed in one task.
SAMPLE_TEXTS = 5_000
PART_TEXTS = 20_000
#: Places of one seed that a task matches at once, and rows that it reads at once.
BLOCK = 50_000
BATCH_SEEDS = 1 << 16
#: Bytes of an Arrow batch of texts or seeds; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
#: Places in a text lie below this; a power of two less one.
PLACES = (1 << 32) - 1
#: A word, as ``Words`` cuts texts.
WORD = r"[^\x20\x09-\x0D]+"
#: Seeds of a chain at least, and the cost of a word of gap in seeds.
LEAST_SEEDS = 2
GAP_COST = 0.01
#: Words beside a chain that its ends may grow into.
MARGIN = 64
#: Score below the best, of 1 for an equal and -2 for another word, at which an end stops.
GROWTH_DROP = 12

#: Words of one stretch of a single word over and over that two texts with as many words beside it, on one side,
#: as make ``LEAST_WORDS`` share a passage by.
RUN_WORDS = math.ceil(AGREE * LEAST_WORDS)
#: Pairs of such stretches that are compared at once.
RUN_PAIRS = 1 << 14

SEEDS = "seed long, doc_id long, place int, reach int"
LINKED = "seed long, doc_id long, place int, reach int, held long"
#: With a passage that the place lies in: the other text (the hub), the place there, the
#: passage's begin and end there, and its words that are not equal, -1 without a passage.
COVER = "hub long, at int, low int, high int, other int"
#: A stretch of one word: its place and words, the words after it, and bytes of the words about its begin and end.
RUNS = f"seed long, doc_id long, place int, words int, after int, head binary, tail binary, {COVER}"
#: Passages with hubs that a text keeps for its places, those with the hubs of most texts.
COVERS = 8
#: Texts that have such passages with one hub from which on these stand for the pairs of these texts.
FAMILY_TEXTS = 16
#: The end of a hub's own passage.
WHOLE = (1 << 31) - 1
MET = "kind int, doc_a long, doc_b long, a int, b int, seed long"
#: Kinds of rows of ``MET``: a match, a place of a seed with many texts, a hub of a part, a place of a
#: seed of few texts that several of them hold more than once. Matches with hubs have no seed.
MATCH, OFTEN, HUB, REPEATED = 0, 1, 2, 3
CHAINS = "doc_a long, doc_b long, from_a int, to_a int, from_b int, to_b int, at_a array<int>, at_b array<int>"
PASSAGES = (
    "doc_a long, doc_b long, start_a long, end_a long, start_b long, end_b long, n_equal long"
)


def kept_seeds(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Positions of the smallest of every ``SPREAD`` seeds in a row of one text."""
    count = len(hashes) - SPREAD + 1
    if count <= 0:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, SPREAD)
    least = np.empty(count, np.int64)
    for i in range(0, count, 1 << 16):
        least[i : i + (1 << 16)] = windows[i : i + (1 << 16)].argmin(axis=1)
    least += np.arange(count)
    return np.unique(least[text_of[:count] == text_of[SPREAD - 1 :]])


def _table(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    names, kinds = zip(*(field.split() for field in schema.split(", ")), strict=True)
    types = {"long": np.int64, "int": np.int32}
    arrays = [pa.array(c.astype(types[k], copy=False)) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _equal_runs(values: np.ndarray, text_of: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of stretches whose values are those ``step`` before, the first ``step`` ones included."""
    same = (values[step:] == values[:-step]) & (text_of[step:] == text_of[:-step])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    return edges[::2], edges[1::2] + step


def _inner(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Marks of seeds inside long stretches of one word, which match by their begins and ends."""
    begin, end = _equal_runs(hashes, text_of)
    long = end - begin > AGAIN
    marks = np.zeros(len(hashes) + 1, np.int8)
    marks[begin[long] + 1] += 1
    marks[end[long] - GROUP] -= 1
    return np.cumsum(marks[:-1]) > 0


def repeating(hashes: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Positions of the first and the last seed of stretches that repeat with an equal one ``AGAIN`` words after it.

    Of the seeds of a period the smallest counts, wherever the stretch begins.
    """
    found = [np.empty(0, np.int64)]
    for period in range(1, PERIOD + 1):
        begin, end = _equal_runs(hashes, text_of, period)
        long = end - begin >= AGAIN + period
        begin, end = begin[long], end[long]
        first = begin + hashes[begin[:, None] + np.arange(period)].argmin(axis=1)
        found += [first, end - 1 - AGAIN - (end - 1 - AGAIN - first) % period]
    return np.unique(np.concatenate(found))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept seeds of each text, and those of stretches that repeat under a hash of their own, with their reach."""
    constant = odd_constants(1, 59)[0]
    for batch in batches:
        words = Words(batch.column("text"))
        hashes, begins = words.groups(GROUP)
        text = words.text_of[begins]
        kept, again = kept_seeds(hashes, text), repeating(hashes, text)
        kept = kept[~_inner(hashes, text)[kept]]
        seeds = np.concatenate((hashes[kept], mixed(hashes[again] ^ constant)))
        reach = np.repeat([0, AGAIN], [len(kept), len(again)])
        begins = begins[np.concatenate((kept, again))]
        text = words.text_of[begins]
        ids = batch.column("doc_id").to_numpy()
        yield _table(SEEDS, [seeds.view(np.int64), ids[text], begins - words.first[text], reach])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different seeds of each text, without their places."""
    for batch in _seeds(batches):
        seed, doc_id = (batch.column(n).to_numpy() for n in ("seed", "doc_id"))
        order = np.lexsort((seed, doc_id))
        seed, doc_id = seed[order], doc_id[order]
        new = np.ones(len(seed), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (doc_id[1:] != doc_id[:-1])
        yield _table("seed long, doc_id long", [seed[new], doc_id[new]])


def matched(group: np.ndarray, doc: np.ndarray, often: np.ndarray) -> tuple:
    """Matches of places sorted by group, text and place, as ``(rows of a, rows of b, ...)``.

    Groups of up to ``FEW_TEXTS`` texts give all pairs of texts, others those with their
    first and last text, and so do groups with a mark of ``often``. A place meets the
    first one in the other text. The rows of these groups and of their hubs follow.
    """
    begins = np.ones(len(doc), bool)
    begins[1:] = (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(begins)
    text = np.cumsum(begins) - 1
    starts = np.ones(len(first), bool)
    starts[1:] = group[first[1:]] != group[first[:-1]]
    low = np.flatnonzero(starts)
    count = np.diff(np.append(low, len(first)))
    of = np.cumsum(starts) - 1
    many = (count > FEW_TEXTS) | often[first[low]]
    row_many = many[of[text]]
    sides: list[tuple[np.ndarray, np.ndarray]] = []
    few = np.flatnonzero(~row_many)
    for step in range(1, FEW_TEXTS):
        on = few[text[few] + step < len(first)]
        on = on[of[text[on] + step] == of[text[on]]]
        sides.append((on, first[text[on] + step]))
        # The first place was met as the other side's first one.
        back = few[(text[few] >= step) & ~begins[few]]
        back = back[of[text[back] - step] == of[text[back]]]
        sides.append((first[text[back] - step], back))
    hot = np.flatnonzero(row_many)
    least, most = low[of[text[hot]]], (low + count - 1)[of[text[hot]]]
    after = text[hot] != least
    sides.append((first[least[after]], hot[after]))
    between = after & (text[hot] != most)
    sides.append((hot[between], first[most[between]]))
    a, b = (np.concatenate(side) for side in zip(*sides, strict=True))
    return a, b, hot, np.unique(first[np.concatenate((low[many], (low + count - 1)[many]))])


def _repeated(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether places sorted by group and text are of a group that two texts or more hold more than once."""
    if not len(doc):
        return np.zeros(0, bool)
    begins = np.ones(len(doc), bool)
    begins[1:] = (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(begins)
    often = np.diff(np.append(first, len(doc))) > 1
    number = np.unique(group, return_inverse=True)[1]
    return (np.bincount(number[first], often) > 1)[number]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of seeds that come in order of seed, part, text and place.

    Only the last seed's places wait for the next batch; one of more than ``BLOCK`` places
    is matched block by block, each with the first text of the seed.
    """
    names = ["seed", "part", "doc_id", "place", "reach"]
    wait = [np.empty(0, np.int64)] * len(names)
    going = False

    def rows(given: list[np.ndarray], often: bool) -> Iterator[pa.RecordBatch]:
        seed, part, doc, place, reach = given
        if not len(seed):
            return
        change = np.ones(len(seed), bool)
        change[1:] = (seed[1:] != seed[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(change)
        # Seeds of one text are most of all: they go first. So do repeated rows.
        other = np.zeros(len(seed), bool)
        other[1:] = ~change[1:] & (doc[1:] != doc[:-1])
        many = (part > 0) | often
        use = (np.bincount(group, other) > 0)[group] | many
        use[1:] &= change[1:] | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        group, seed, part, doc, place, reach, many = (c[use] for c in (group, seed, part, doc, place, reach, many))
        a, b, hot, hubs = matched(group, doc, many)
        few = np.ones(len(doc), bool)
        few[hot] = False
        own = np.where(few, seed, 0)[a]
        ends = [(doc[a], doc[b], place[a], place[b], own)]
        wide = reach[a] > 0
        ends.append((doc[a][wide], doc[b][wide], (place + reach)[a][wide], (place + reach)[b][wide], own[wide]))
        for doc_a, doc_b, x, y, of in ends:
            yield _table(MET, [np.full(len(x), MATCH), doc_a, doc_b, x, y, of])
        more = np.flatnonzero(few & (reach == 0))
        more = more[_repeated(group[more], doc[more])]
        for kind, at in ((OFTEN, hot), (HUB, hubs[part[hubs] > 0]), (REPEATED, more)):
            yield _table(MET, [np.full(len(at), kind), doc[at], doc[at], place[at], reach[at], seed[at]])

    for batch in batches:
        given = [np.concatenate((w, batch.column(n).to_numpy())) for w, n in zip(wait, names, strict=True)]
        seed, part = given[0], given[1]
        if not len(seed):
            continue
        last = int(np.flatnonzero((seed != seed[-1]) | (part != part[-1]))[-1:].sum() + 1) if (seed[0], part[0]) != (seed[-1], part[-1]) else 0
        if going and last:
            # The end of the seed that went on from the last block.
            stop = int(np.flatnonzero((seed != seed[0]) | (part != part[0]))[0])
            yield from rows([c[:stop] for c in given], True)
            given, last, going = [c[stop:] for c in given], last - stop, False
        yield from rows([c[:last] for c in given], False)
        wait = [c[last:] for c in given]
        if len(wait[0]) > BLOCK:
            yield from rows(wait, True)
            wait, going = [c[:1] for c in wait], True
    yield from rows(wait, going)


def _classes(place: np.ndarray, seed: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per place ``at`` and range of seeds the hash of ``CLASS_WORDS`` words in a row that begin in it, and their distance.

    Words in a row are those that frequent seeds cover without a gap. Of several stretches
    the one with the smallest hash counts, as texts with the same words mostly agree in it;
    0 if there is none, or too few words before it to make a passage.
    """
    n = len(place)
    if not len(at):
        return np.zeros(0, np.int64)
    run = np.concatenate(([0], np.cumsum(np.diff(place) > GROUP)))
    end = np.searchsorted(place, place + CLASS_WORDS - GROUP)
    whole = (end < n) & (run[np.minimum(end, n - 1)] == run)
    whole &= (place & PLACES) >= LEAST_WORDS - CLASS_WORDS
    constants = odd_constants(CLASS_WORDS + 2 * GROUP, 41)
    start = np.flatnonzero(whole)
    sums = np.zeros(len(start), np.uint64)
    for step in range(int((end - np.arange(n))[start].max(initial=-1)) + 1):
        inside = np.flatnonzero(start + step <= end[start])
        to = start[inside] + step
        sums[inside] += mixed(seed[to] ^ constants[place[to] - place[start[inside]]])
    none = ~np.uint64(0)
    value = np.full(n, none)
    value[start] = mixed(sums)
    # Least values of ranges, from those of ranges of powers of two.
    least = [np.arange(n)]
    size = np.maximum(high - low, 1)
    for power in range(int(size.max(initial=1)).bit_length() - 1):
        one = least[-1]
        other = one[np.minimum(np.arange(n) + (1 << power), n - 1)]
        least.append(np.where(value[other] < value[one], other, one))
    level = np.frexp(size.astype(np.float64))[1] - 1
    table = np.stack(least)
    one, other = table[level, low], table[level, np.maximum(low, high - (1 << level))]
    best = np.where(value[other] < value[one], other, one)
    marks = mixed(value[best] ^ mixed((place[best] - at).view(np.uint64))).view(np.int64)
    return np.where((value[best] == none) | (high <= low), 0, marks)


def implied(cover: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the texts of rows ``a`` and ``b`` share a passage at these places by their passages with one hub.

    Of ``n`` words of the hub that both passages cover, each text holds all but its ``other`` words,
    so both hold the rest, in order, within at most ``n`` and its ``other`` words.
    """
    hub, at, low, high, other = (c.astype(np.int64, copy=False) for c in cover)
    out = np.zeros(len(a), bool)
    on = np.flatnonzero((other[a] >= 0) & (other[b] >= 0) & (hub[a] == hub[b]))
    x, y = a[on], b[on]
    apart = other[x] + other[y]
    both = np.minimum(high[x], high[y]) - np.maximum(low[x], low[y])
    equal = both - apart
    held = (equal >= LEAST_WORDS) & (equal >= AGREE * (both + np.maximum(other[x], other[y])))
    out[on] = held & (np.abs(at[x] - at[y]) <= apart)
    return out


def _covered(covers: pa.Array, text: np.ndarray, place: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
    """Columns of ``COVER`` of linked pairs: of the passages that hold both seeds the one listed first."""
    names = ["hub", "hub_low", "hub_high", "low", "high", "other"]
    sizes = np.nan_to_num(covers.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = covers.flatten()
    hub, hub_low, hub_high, low, high, other = (flat.field(n).to_numpy().astype(np.int64) for n in names)
    first = np.cumsum(sizes) - sizes
    out = [np.zeros(len(place), np.int64) for _ in range(4)] + [np.full(len(place), -1)]
    for rank in reversed(range(int(sizes.max(initial=0)))):
        rows = np.flatnonzero(sizes[text] > rank)
        of = first[text[rows]] + rank
        inside = (place[rows] >= low[of]) & (place[rows] + reach[rows] + GROUP <= high[of])
        rows, of = rows[inside], of[inside]
        values = (hub[of], hub_low[of] + place[rows] - low[of], hub_low[of], hub_high[of], other[of])
        for column, value in zip(out, values, strict=True):
            column[rows] = value
    return out


def _links(place: np.ndarray, seed: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position of the first seed, words to the second, joint hash)`` of linked pairs of seeds in order of places.

    In every window after a seed the pair of the smallest hash; but all pairs of a seed of ``few`` and another one.
    """
    constants = odd_constants(WINDOWS[-1], 23)
    n, bounds = len(place), np.array(WINDOWS)
    none, width = ~np.uint64(0), len(WINDOWS) - 1
    least, reach = np.full(n * width, none), np.zeros(n * width, np.int64)
    mixtures = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    stop = np.searchsorted(place, place + WINDOWS[-1])
    # The begin and the end of a stretch of one word are not linked.
    run = np.concatenate(([0], np.cumsum((seed[1:] == seed[:-1]) & (np.diff(place) > GROUP))))
    for step in range(1, int((stop - np.arange(n)).max(initial=0))):
        at = np.flatnonzero(np.arange(n) + step < stop)
        far = place[at + step] - place[at]
        one, other = few[at], few[at + step]
        use = np.where(one | other, ~(one & other), far >= bounds[0])
        use &= (seed[at] != seed[at + step]) | (run[at] == run[at + step])
        at, far, mixture = at[use], far[use], (one | other)[use]
        value = mixed(seed[at] * constants[0] ^ mixed(seed[at + step] ^ constants[far]))
        mixtures.append((at[mixture], far[mixture], value[mixture]))
        at, far, value = at[~mixture], far[~mixture], value[~mixture]
        cell = at * width + np.searchsorted(bounds, far, "right") - 1
        smaller = value < least[cell]
        cell = cell[smaller]
        least[cell], reach[cell] = value[smaller], far[smaller]
    held = np.flatnonzero(reach)
    mixtures.append((held // width, reach[held], least[held]))
    at, far, value = (np.concatenate(c) for c in zip(*mixtures, strict=True))
    return at, far, value


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linked pairs of each text's seeds."""
    for batch in batches:
        own, ids = batch.column("own"), batch.column("doc_id").to_numpy()
        flat, sizes = own.flatten(), own.value_lengths().to_numpy()
        place, seed, few = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("a", "seed", "few"))
        # Texts far apart on one line of places.
        place = place.astype(np.int64) + np.repeat(np.arange(len(sizes)), sizes) * (PLACES + 1)
        order = np.lexsort((few, place))
        place, at = np.unique(place[order], return_index=True)
        seed, few = seed[order[at]].view(np.uint64), few[order[at]]
        first, reach, value = _links(place, seed, few)
        own_place, text = place[first], place[first] // (PLACES + 1)
        low = np.searchsorted(place, own_place - CLASS_WORDS)
        low = np.maximum(low, np.searchsorted(place, own_place - (own_place & PLACES)))
        classes = np.zeros(len(first), np.int64)
        wide = reach >= WIDE
        classes[wide] = _classes(place, seed, own_place[wide], low[wide], np.searchsorted(place, (own_place + reach)[wide]))
        cover = _covered(batch.column("covers"), text, own_place & PLACES, reach)
        yield _table(f"{LINKED}, {COVER}", [value.view(np.int64), ids[text], own_place & PLACES, reach, classes, *cover])


def _classed(text: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Per text the row that puts it in a class, of those it could be in the largest; -1 if in none with others."""
    out = np.full(int(text[-1]) + 1, -1)
    rows = np.flatnonzero(held)
    if not len(rows):
        return out
    number = np.unique(held[rows], return_inverse=True)[1]
    order = np.lexsort((text[rows], number))
    new = np.ones(len(rows), bool)
    new[1:] = (np.diff(number[order]) != 0) | (np.diff(text[rows][order]) != 0)
    size = np.bincount(number[order], new)[number]
    order = np.lexsort((number, -size, text[rows]))
    best = order[np.diff(text[rows][order], prepend=-1) != 0]
    # Other members may be in larger classes.
    best = best[np.bincount(number[best], minlength=number.max() + 1)[number[best]] > 1]
    out[text[rows[best]]] = rows[best]
    return out


def _apart(group: np.ndarray, new: np.ndarray, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matches of the places of linked pairs, as rows of both sides, but for texts of one class.

    Places are in order of linked pair (``group``) and text; ``new`` marks a text's first one. As in
    ``matched``, a place meets the first one in the other text. The texts of a class meet its first text.
    """
    first, text = np.flatnonzero(new), np.cumsum(new) - 1
    # Classes of different linked pairs are different ones.
    own = np.where(held == 0, 0, mixed(held.view(np.uint64) ^ mixed(group.astype(np.uint64) + np.uint64(1))).view(np.int64))
    at = _classed(text, own)
    kind = np.where(at < 0, 0, own[at])
    members = np.flatnonzero(kind)
    members = members[np.argsort(kind[members], kind="stable")]
    begins = np.flatnonzero(np.diff(kind[members], prepend=0)) if len(members) else members
    heads = np.repeat(members[begins], np.diff(np.append(begins, len(members))))
    yield at[heads[members != heads]], at[members[members != heads]]
    # The texts that a place meets: those after it, and for a text's further places those before it as well.
    starts = np.concatenate(([True], group[first[1:]] != group[first[:-1]]))
    low = np.flatnonzero(starts)
    high = np.append(low[1:], len(first))
    of = (np.cumsum(starts) - 1)[text]
    begin = np.where(new, text + 1, low[of])
    cells = np.cumsum(high[of] - begin)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(cells, (cells[i - 1] if i else 0) + CELLS, "right")))
        counts = (high[of] - begin)[i:j]
        row = np.repeat(np.arange(i, j), counts)
        other = np.arange(len(row)) + np.repeat(begin[i:j] - np.cumsum(counts) + counts, counts)
        use = (other != text[row]) & ((kind[other] != kind[text[row]]) | (kind[other] == 0))
        row, other = row[use], other[use]
        after = other > text[row]
        yield np.where(after, row, first[other]), np.where(after, first[other], row)
        i = j


def _all_implied(starts: np.ndarray, cover: list[np.ndarray]) -> np.ndarray:
    """Whether ``implied`` holds for each two rows of the groups that begin at ``starts``, by the worst of their rows."""
    hub, at, low, high, other = (c.astype(np.int64, copy=False) for c in cover)
    least, most = np.minimum.reduceat, np.maximum.reduceat
    both, worst = least(high, starts) - most(low, starts), most(other, starts)
    out = (least(other, starts) >= 0) & (least(hub, starts) == most(hub, starts))
    equal = both - 2 * worst
    out &= (equal >= LEAST_WORDS) & (equal >= AGREE * (both + worst))
    return out & (most(at, starts) - least(at, starts) <= 2 * least(other, starts))


def _met_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of linked pairs that come in order of seed, text and place.

    The places of one linked pair wait until its last one; its matches go out in parts.
    Those that the passages with a hub imply are left out, if the rows have columns of ``COVER``.
    """
    names = ["seed", "doc_id", "place", "reach", "held"]
    covers = [field.split()[0] for field in COVER.split(", ")]
    wait: list[list[np.ndarray]] = []

    def table(given: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc, place, reach, *cover = given
        if cover:
            shown = implied(cover, a, b)
            a, b = a[~shown], b[~shown]
        for far in (0, reach[a]) if len(a) else ():
            yield _table(MET, [np.full(len(a), MATCH), doc[a], doc[b], place[a] + far, place[b] + far, np.zeros(len(a))])

    def rows(given: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seed, doc, place, reach, held, *cover = given
        if not len(seed):
            return
        change = np.ones(len(seed), bool)
        change[1:] = seed[1:] != seed[:-1]
        new = change.copy()
        new[1:] |= doc[1:] != doc[:-1]
        group = np.cumsum(change) - 1
        texts = np.bincount(group, new)[group]
        # Of words that repeat without a gap the first and the last place meet.
        on = ~new[1:] & (np.diff(place) <= GROUP)
        inner = np.concatenate(([False], on)) & np.concatenate((on, [False]))
        use = (texts > 1) & (texts <= FEW_TEXTS) & ~inner
        few = [c[use] for c in (group, doc, place, reach, *cover)]
        if use.any():
            a, b, _, _ = matched(few[0], few[1], np.zeros(len(few[0]), bool))
            yield from table(few[1:], a, b)
        many = np.flatnonzero((texts > FEW_TEXTS) & (reach >= WIDE) & ~inner)
        if cover and len(many):
            starts = np.flatnonzero(np.diff(group[many], prepend=-1))
            shown = _all_implied(starts, [c[many] for c in cover])
            many = many[~np.repeat(shown, np.diff(np.append(starts, len(many))))]
        if len(many):
            there = [c[many] for c in (doc, place, reach, *cover)]
            for a, b in _apart(group[many], new[many], held[many]):
                yield from table(there, a, b)

    for batch in batches:
        if len(names) < 5 + len(covers) and covers[0] in batch.schema.names:
            names += covers
        own = [batch.column(n).to_numpy() for n in names]
        if not len(own[0]):
            continue
        last = int(np.searchsorted(own[0], own[0][-1]))
        if wait and own[0][0] == wait[0][0][0] and not last:
            wait.append(own)
            continue
        wait.append([c[:last] for c in own])
        yield from rows([np.concatenate(c) for c in zip(*wait, strict=True)])
        wait = [[c[last:] for c in own]]
    if wait:
        yield from rows([np.concatenate(c) for c in zip(*wait, strict=True)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of ``AGAIN + GROUP`` words or more of one word."""
    about = np.arange(-MARGIN, MARGIN)

    def binary(bytes_: np.ndarray) -> pa.Array:
        offsets = np.arange(len(bytes_) + 1, dtype=np.int32) * bytes_.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(bytes_), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_.tobytes())])

    for batch in batches:
        words, ids = Words(batch.column("text")), batch.column("doc_id").to_numpy()
        begin, end = _equal_runs(words.hashes, words.text_of)
        long = end - begin >= AGAIN + GROUP
        begin, end = begin[long], end[long]
        text = words.text_of[begin]
        # Equal words have equal bytes, other words mostly not; 0 is no word.
        codes = np.maximum(words.hashes >> np.uint64(56), np.uint64(1)).astype(np.uint8)
        sides = []
        for middle in (begin, end):
            at = middle[:, None] + about
            there = (at >= words.first[text][:, None]) & (at < words.first[text + 1][:, None])
            sides.append(binary(np.where(there, codes[np.clip(at, 0, max(len(codes) - 1, 0))], 0).astype(np.uint8)))
        place = begin - words.first[text]
        cover = _covered(batch.column("covers"), text, place, np.full(len(place), AGAIN))
        plain = [mixed(words.hashes[begin]).view(np.int64), ids[text], place, end - begin, words.first[text + 1] - end]
        names = [field.split()[0] for field in RUNS.split(", ")]
        one = _table("seed long, doc_id long, place int, words int, after int", plain).columns
        yield pa.RecordBatch.from_arrays([*one, *sides, *_table(COVER, cover).columns], names)


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of bytes of words may hold a passage without shifts: none that does is left out."""
    same = (x == y) & (x != 0)
    out = np.zeros(len(x), bool)
    rows = np.flatnonzero(same.sum(axis=1) >= RUN_WORDS)
    over = np.zeros((len(rows), x.shape[1] + 1))
    np.cumsum(same[rows], axis=1, out=over[:, 1:])
    over -= AGREE * np.arange(over.shape[1])
    out[rows] = (over[:, LEAST_WORDS:] >= np.minimum.accumulate(over, axis=1)[:, :-LEAST_WORDS]).any(axis=1)
    return out


def run_pairs(doc: np.ndarray, place: np.ndarray, words: np.ndarray, after: np.ndarray, head: np.ndarray, tail: np.ndarray):
    """Pairs of stretches of one word by different texts, in order of texts: parts ``(a, b, place in a, in b, by class)``.

    Of ``RUN_WORDS`` words and as many words after the begin, or before the end, as make ``LEAST_WORDS``, any two
    share a passage: these are a class, whose members meet its first text. All other pairs are compared by the words about
    their begins and about their ends.
    """
    last = place + words - AGAIN - GROUP
    right = (words >= RUN_WORDS) & (words + after >= LEAST_WORDS)
    left = (words >= RUN_WORDS) & (place + words >= LEAST_WORDS)
    both = right & left
    # The text ends soon after one and begins soon before the other: of both ``LEAST_WORDS`` words meet at these ends.
    for i in np.flatnonzero(right & ~left):
        others = np.flatnonzero(left & ~right)
        others = others[doc[others] != doc[i]]
        start = (place + words + after)[others] - LEAST_WORDS
        low = np.maximum(place[others] - start, place[i])
        fits = np.minimum((place + words)[others] - start, place[i] + words[i]) - low >= RUN_WORDS
        other, low, far = others[fits], low[fits], (low + start)[fits]
        yield np.minimum(i, other), np.maximum(i, other), np.where(other > i, low, far), np.where(other > i, far, low), True
    for side, at in ((right, place), (left & ~right if both.any() else left, last)):
        members = np.flatnonzero(side)
        if not len(members):
            continue
        first = np.flatnonzero(both)[0] if both.any() else members[0]
        others = members[doc[members] != doc[first]]
        # Further stretches of the first text meet the second text's first one.
        more = members[(doc[members] == doc[first]) & (members != first)] if len(others) else members[:0]
        a, b = np.append(np.full(len(others), first), more), np.append(others, np.repeat(others[:1], len(more)))
        a, b = np.minimum(a, b), np.maximum(a, b)
        yield a, b, at[a], at[b], True
    # The pairs that are not of one class, in pieces.
    order = np.argsort(right | left, kind="stable")
    plain = len(doc) - int((right | left).sum())
    pieces = [(order[i], order[i + 1 :]) for i in range(plain)]
    wait: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for i, js in itertools.chain(pieces, [(-1, np.empty(0, np.int64))]):
        if i >= 0:
            js = js[doc[js] != doc[i]]
            wait.append((np.minimum(i, js), np.maximum(i, js)))
            size += len(js)
        if wait and (size >= RUN_PAIRS or i < 0):
            a, b = (np.concatenate(c) for c in zip(*wait, strict=True))
            wait, size = [], 0
            for k in range(0, len(a), RUN_PAIRS):
                x, y = a[k : k + RUN_PAIRS], b[k : k + RUN_PAIRS]
                by_head = agreeing(head[x], head[y])
                yield x[by_head], y[by_head], place[x[by_head]], place[y[by_head]], False
                x, y = x[~by_head], y[~by_head]
                by_tail = agreeing(tail[x], tail[y])
                yield x[by_tail], y[by_tail], last[x[by_tail]], last[y[by_tail]], False


def _met_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of stretches that come in order of their word, text and place, of words that more than ``FEW_TEXTS`` texts repeat."""
    plain = ["seed", "doc_id", "place", "words", "after"]
    covers = [field.split()[0] for field in COVER.split(", ")]
    wait: list[list[np.ndarray]] = []

    def rows(given: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seed = given[0]
        edges = np.flatnonzero(np.concatenate(([True], seed[1:] != seed[:-1], [True]))) if len(seed) else np.empty(0, np.int64)
        for begin, end in itertools.pairwise(edges.tolist()):
            doc, place, words, after, head, tail, *cover = (c[begin:end] for c in given[1:])
            if 1 + np.count_nonzero(np.diff(doc)) <= FEW_TEXTS:
                continue
            for a, b, at_a, at_b, classed in run_pairs(doc, place, words, after, head, tail):
                if not classed:
                    alone = ~implied(cover, a, b)
                    a, b, at_a, at_b = a[alone], b[alone], at_a[alone], at_b[alone]
                for far in (0, AGAIN) if len(a) else ():
                    yield _table(MET, [np.full(len(a), MATCH), doc[a], doc[b], at_a + far, at_b + far, np.zeros(len(a))])

    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(n).to_numpy() for n in plain]
        for name in ("head", "tail"):
            column = batch.column(name)
            data = np.concatenate([np.frombuffer(column[i].as_buffer(), np.uint8) for i in range(len(column))])
            own.append(data.reshape(len(column), 2 * MARGIN))
        own += [batch.column(n).to_numpy() for n in covers]
        last = int(np.flatnonzero(own[0] == own[0][-1])[0])
        if wait and own[0][0] == wait[0][0][0] and not last:
            wait.append(own)
            continue
        wait.append([c[:last] for c in own])
        yield from rows([np.concatenate(c) for c in zip(*wait, strict=True)])
        wait = [[c[last:] for c in own]]
    if wait:
        yield from rows([np.concatenate(c) for c in zip(*wait, strict=True)])


def chains(at_a: np.ndarray, at_b: np.ndarray) -> list[list[int]]:
    """Collinear chains of matches sorted by ``at_a, at_b``, best first; each match is in one.

    ``f(i) = 1 + max(0, max f(j) - GAP_COST * words between j and i)`` over matches j
    before i on both sides. As the cost is a sum over both sides, the inner maximum is
    one of a prefix, which the Fenwick tree holds.
    """
    n = len(at_a)
    step = np.diff(at_a), np.diff(at_b)
    if (step[0] > 0).all() and (step[1] > 0).all():
        # All in one order: the best match before is the last one.
        score, before, total = [0.0] * n, [-1] * n, 0.0
        gaps = [0.0, *(GAP_COST * (step[0] + step[1])).tolist()]
        for i, gap in enumerate(gaps[:n]):
            before[i] = i - 1 if total > gap else -1
            score[i] = total = 1 + max(0.0, total - gap)
        return _best_first(score, before)
    rank = (np.unique(at_b, return_inverse=True)[1] + 1).tolist()
    size = max(rank, default=0)
    cost = (GAP_COST * (at_a + at_b)).tolist()
    best = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    a = at_a.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and a[j] == a[i]:
            top, source, r = -1e18, -1, rank[j] - 1
            while r:
                if best[r][0] > top:
                    top, source = best[r]
                r &= r - 1
            gain = top - cost[j]
            score[j], before[j] = (1 + gain, source) if gain > 0 else (1.0, -1)
            j += 1
        # Matches at one place of `a` do not follow each other.
        for t in range(i, j):
            value, r = (score[t] + cost[t], t), rank[t]
            while r <= size:
                if value[0] > best[r][0]:
                    best[r] = value
                r += r & -r
        i = j
    return _best_first(score, before)


def _best_first(score: list[float], before: list[int]) -> list[list[int]]:
    """Chains of at least ``LEAST_SEEDS`` matches by their ends, each match in one."""
    n = len(score)
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda t: (-score[t], t)):
        chain, t = [], end
        while t >= 0 and not used[t]:
            used[t] = True
            chain.append(t)
            t = before[t]
        if len(chain) >= LEAST_SEEDS:
            out.append(chain[::-1])
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_a", "doc_b", "from_a", "to_a", "from_b", "to_b", "at_a", "at_b"]
    kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())] * 2

    def rows(pair: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        starts, last = ends[:-1], ends[1:] - 1
        flat = [doc_a[pair], doc_b[pair], a[starts], a[last] + GROUP, b[starts], b[last] + GROUP]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(flat, kinds, strict=False)] + lists, names)

    for batch in batches:
        doc_a, doc_b = (batch.column(n).to_numpy() for n in ("doc_a", "doc_b"))
        both, sizes = batch.column("matches").flatten().to_numpy(), batch.column("matches").value_lengths().to_numpy()
        pair = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((both, pair))
        pair, both = pair[order], both[order]
        new = np.ones(len(both), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (both[1:] != both[:-1])
        pair, both = pair[new], both[new]
        at_a, at_b = both >> 32, both & 0xFFFFFFFF
        # In one order and without a gap that costs a match, all matches of a pair are one chain.
        step_a, step_b = np.diff(at_a), np.diff(at_b)
        apart = (step_a <= 0) | (step_b <= 0) | (GAP_COST * (step_a + step_b) >= 1)
        apart &= pair[1:] == pair[:-1]
        hard = np.zeros(len(sizes), bool)
        hard[pair[1:][apart]] = True
        count = np.bincount(pair, minlength=len(sizes))
        plain = np.flatnonzero(~hard & (count >= LEAST_SEEDS))
        use = np.isin(pair, plain)
        yield rows(plain, np.concatenate(([0], np.cumsum(count[plain]))), at_a[use], at_b[use])
        found, members, ends = [], [np.empty(0, np.int64)], [0]
        start = np.concatenate(([0], np.cumsum(count)))
        for i in np.flatnonzero(hard).tolist():
            for chain in chains(at_a[start[i] : start[i + 1]], at_b[start[i] : start[i + 1]]):
                found.append(i)
                members.append(start[i] + np.array(chain))
                ends.append(ends[-1] + len(chain))
        inside = np.concatenate(members)
        yield rows(np.array(found, np.int64), np.array(ends, np.int64), at_a[inside], at_b[inside])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(batch.column("text"))
        short = (words.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(short))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "words"])


def _grown(a: list[int], b: list[int], i: int, j: int, step: int) -> tuple[int, int]:
    """Equal and all words gained by going on from ``i, j`` while most words agree."""
    score = best = gained = length = equal = steps = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > best - GROWTH_DROP:
        steps += 1
        same = a[i] == b[j]
        equal += same
        score += 1 if same else -2
        if score > best:
            best, gained, length = score, equal, steps
        i, j = i + step, j + step
    return gained, length


def _between(a: list[int], b: list[int]) -> int:
    """Equal words of two gaps, in order."""
    if not a or not b:
        return 0
    return common_subsequence(places(tuple(a)), len(a), b)


def _widest(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int, int] | None:
    """``(words before, words from it on, equal words)`` of the longest passage without shifts about ``i, j``.

    Of ends within ``MARGIN``, those with the most words of which ``AGREE`` are equal.
    """
    before, after = min(i, j), min(len(a) - i, len(b) - j)
    same = a[i - before : i + after] == b[j - before : j + after]
    sums = np.concatenate(([0], np.cumsum(same)))
    # What is over after each word, and the least before it: without an end that is
    # over the least start, no passage is there.
    over = sums - AGREE * np.arange(len(sums))
    ends = np.arange(max(before, LEAST_WORDS), len(sums))
    starts = np.minimum(before, ends - LEAST_WORDS)
    if not (over[ends] >= np.minimum.accumulate(over)[starts]).any():
        return None
    equal = (sums[before] - sums[before::-1])[:, None] + (sums[before:] - sums[before])
    length = np.arange(before + 1)[:, None] + np.arange(after + 1)
    fits = np.where((length >= LEAST_WORDS) & (equal >= AGREE * length), length, 0)
    head, tail = np.unravel_index(fits.argmax(), fits.shape)
    return (int(head), int(tail), int(equal[head, tail])) if fits[head, tail] else None


def _grown_along(same: bytes, i: int) -> tuple[int, int]:
    """As ``_grown``, from ``i`` on over marks of equal words, run by run."""
    score = best = gained = length = equal = 0
    at, stop = i, len(same)
    while at < stop and score > best - GROWTH_DROP:
        end = same.find(0, at)
        end = stop if end < 0 else end
        equal, score = equal + end - at, score + end - at
        if score > best:
            best, gained, length = score, equal, end - i
        score, at = score - 2, end + 1
    return gained, length


def align_straight(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, shift: int) -> tuple[int, int, int, int, int]:
    """``align`` of a chain whose matches are all ``shift`` words further on in ``b``."""
    low = max(0, -shift)
    n = min(len(a), len(b) - shift) - low
    same = (a[low : low + n] == b[low + shift : low + shift + n]).tobytes()
    start = x = int(at_a[0]) - low
    equal, seed = 0, b"\x01" * GROUP
    for i in (at_a - low).tolist():
        if same[i : i + GROUP] != seed:
            continue
        if i > x:
            other = same.count(0, x, i)
            # One other word among equal ones is one less; more may still be equal in order.
            p, q = x + low, i + low
            equal += i - x - other if other < 2 else _between(a[p:q].tolist(), b[p + shift : q + shift].tolist())
            x = i
        equal += i + GROUP - x
        x = i + GROUP
    head, head_length = _grown_along(same[:start][::-1], 0)
    tail, tail_length = _grown_along(same, x)
    a0, a1 = start + low - head_length, x + low + tail_length
    return a0, a1, a0 + shift, a1 + shift, equal + head + tail


def align(a: list[int], b: list[int], at_a: list[int], at_b: list[int]) -> tuple[int, int, int, int, int]:
    """``(start_a, end_a, start_b, end_b, equal words)`` of a chain on two word lists."""
    equal, x, y = 0, at_a[0], at_b[0]
    for i, j in zip(at_a, at_b, strict=True):
        # Not so for another text of the same id, or if two seeds' hashes met by chance.
        if a[i : i + GROUP] != b[j : j + GROUP]:
            continue
        # Where seeds overlap differently on both sides, the longer side waits.
        if i >= x and j >= y:
            equal += _between(a[x:i], b[y:j]) + GROUP
            x, y = i + GROUP, j + GROUP
        elif i - x == j - y:
            equal += i + GROUP - x
            x, y = i + GROUP, j + GROUP
    head, head_length = _grown(a, b, at_a[0] - 1, at_b[0] - 1, -1)
    tail, tail_length = _grown(a, b, x, y, 1)
    return at_a[0] - head_length, x + tail_length, at_b[0] - head_length, y + tail_length, equal + head + tail


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as views of one array."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in itertools.pairwise(offsets.tolist())]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        flat = [batch.column(n).to_pylist() for n in ("doc_a", "doc_b", "low_a", "low_b")]
        wide = [_lists(batch.column(n)) for n in ("words_a", "words_b", "at_a", "at_b")]
        for doc_a, doc_b, low_a, low_b, a, b, at_a, at_b in zip(*flat, *wide, strict=True):
            at_a, at_b = at_a - low_a, at_b - low_b
            shift = int(at_b[0] - at_a[0])
            # A text of the same id that is shorter than the one the chain is of has no such places.
            if at_a[-1] < len(a) and at_b[-1] < len(b) and (at_b - at_a == shift).all():
                a0, a1, b0, b1, equal = align_straight(a, b, at_a, shift)
            else:
                a0, a1, b0, b1, equal = align(a.tolist(), b.tolist(), at_a.tolist(), at_b.tolist())
            if min(a1 - a0, b1 - b0) < LEAST_WORDS or equal < AGREE * max(a1 - a0, b1 - b0):
                # Ends that stopped among replaced words may still go on.
                tried: set[int] = set()
                for x, y in zip(at_a.tolist(), at_b.tolist(), strict=True):
                    if y - x not in tried and len(b[y : y + GROUP]) == GROUP and np.array_equal(a[x : x + GROUP], b[y : y + GROUP]):
                        tried.add(y - x)
                        found = _widest(a, b, x, y)
                        if found:
                            before, after, equal = found
                            a0, a1, b0, b1 = x - before, x + after, y - before, y + after
                            break
            if min(a1 - a0, b1 - b0) >= LEAST_WORDS and equal >= AGREE * max(a1 - a0, b1 - b0):
                rows.append((doc_a, doc_b, a0 + low_a, a1 + low_a, b0 + low_b, b1 + low_b, equal))
        names = ["doc_a", "doc_b", "start_a", "end_a", "start_b", "end_b", "n_equal"]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)


def _copies(given: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Texts without their copies, the passages of these, ids of several texts, and the number of texts."""
    digest = F.xxhash64("text").alias("digest")
    rows = given.select("doc_id", digest).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    rows = written(rows, "digests")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.sum("rows").alias("all")).filter("all > 1")
    copies = written(rows.join(least, "digest"), "copies").filter("doc_id > least or rows > 1")
    marks = copies.select(F.col("doc_id").alias("_copy"), F.col("digest"), (F.col("doc_id") == F.col("least")).alias("_least"))
    same = (F.col("doc_id") == F.col("_copy")) & (F.xxhash64("text") == F.col("digest"))
    texts = given.join(marks.drop("_least"), same, "left_anti")
    # Of a repeated row one stays; they are reduced before they are moved.
    often = given.join(marks.filter("_least").drop("_least"), same, "left_semi")
    texts = texts.union(often.groupBy("doc_id", digest).agg(F.first("text").alias("text")).drop("digest"))
    copies = copies.filter("doc_id > least")
    first = given.join(copies.select(F.col("least").alias("_copy"), "digest"), same, "left_semi")
    counted = first.groupBy("doc_id", digest).agg(F.first(F.regexp_count("text", F.lit(WORD))).alias("words"))
    copies = copies.join(counted.withColumnRenamed("doc_id", "least"), ["least", "digest"])
    n = F.col("words").cast("long")
    whole = [F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(0).cast("long").alias("start_a"), n.alias("end_a")]
    whole += [F.lit(0).cast("long").alias("start_b"), n.alias("end_b"), n.alias("n_equal")]
    several = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("doc_id")
    return texts, copies.filter(F.col("words") >= LEAST_WORDS).select(*whole), several, rows.count()


def _often(texts: DataFrame, n_texts: int) -> DataFrame:
    """``seed, parts`` of seeds in so many texts that several tasks share them, told by a sample."""
    sample = texts.filter(taken(F.xxhash64("doc_id", "text"), SAMPLE_TEXTS, n_texts))
    rate = min(1.0, SAMPLE_TEXTS / max(n_texts, 1))
    held = sample.mapInArrow(_held, "seed long, doc_id long").groupBy("seed").agg(F.count_distinct("doc_id").alias("held"))
    parts = F.ceil(F.col("held") / (rate * PART_TEXTS)).cast("int")
    return held.select("seed", parts.alias("parts")).filter("parts > 1")


def _matches(seeds: DataFrame, often: DataFrame | None, purpose: str) -> DataFrame:
    """``MET`` of ``seed, doc_id, place, reach``."""
    if often is not None:
        seeds = seeds.join(often, "seed", "left")
        part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")) + 1)
    else:
        part = F.lit(0)
    seeds = seeds.select("seed", part.cast("int").alias("part"), "doc_id", "place", "reach")
    met = seeds.repartition("seed", "part").sortWithinPartitions("seed", "part", "doc_id", "place")
    return _by_seed(met, _met, purpose)


def _by_seed(rows: DataFrame, match, purpose: str) -> DataFrame:
    """The matches of rows in order of seeds, read in batches of bounded size."""
    spark = rows.sparkSession
    bounds = {"maxRecordsPerBatch": BATCH_SEEDS, "maxBytesPerBatch": BATCH_BYTES}
    names = [f"spark.sql.execution.arrow.{name}" for name in bounds]
    before = [spark.conf.get(name) for name in names]
    for name, bound in zip(names, bounds.values(), strict=True):
        spark.conf.set(name, str(bound))
    try:
        return written(rows.mapInArrow(match, MET), purpose)
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def _chains(matches: DataFrame, purpose: str) -> DataFrame:
    """``CHAINS`` of grouped matches."""
    grouped = matches.filter(F.size("matches") >= LEAST_SEEDS)
    return written(grouped.select("doc_a", "doc_b", "matches").mapInArrow(_chained, CHAINS), purpose)


def _ends(found: DataFrame) -> DataFrame:
    # The ids grow with the table, so they are never broadcast, whatever their number.
    return found.select(F.col("doc_a").alias("doc_id")).union(found.select("doc_b")).distinct().hint("merge")


def _passages(found: DataFrame, words: DataFrame, purpose: str) -> DataFrame:
    """The passages of chains, with the words of their texts."""
    rows = found
    for side in ("a", "b"):
        low = F.greatest(F.lit(0), F.col(f"from_{side}") - MARGIN)
        own = words.select(F.col("doc_id").alias(f"doc_{side}"), F.col("words").alias("_words"))
        rows = rows.join(own, f"doc_{side}").withColumn(f"low_{side}", low)
        piece = F.slice("_words", F.col(f"low_{side}") + 1, F.col(f"to_{side}") + MARGIN - F.col(f"low_{side}"))
        rows = rows.withColumn(f"words_{side}", piece).drop("_words")
    return written(rows.mapInArrow(_aligned, PASSAGES), purpose)


def _good(rows: DataFrame, several: DataFrame) -> DataFrame:
    """Passages with the hubs of ``FAMILY_TEXTS`` texts or more that can imply others, with ``other`` and ``texts``.

    None of ids with several texts, whose places mean either.
    """
    length = F.greatest(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b"))
    other = (length - F.col("n_equal")).alias("other")
    good = rows.select("*", other).filter((F.col("n_equal") >= LEAST_WORDS) & (F.col("n_equal") >= AGREE * (length + F.col("other"))))
    for side in ("doc_a", "doc_b"):
        good = good.join(several.withColumnRenamed("doc_id", side), side, "left_anti")
    texts = good.groupBy("doc_a").agg(F.count_distinct("doc_b").alias("texts"))
    return good.join(texts.filter(F.col("texts") >= FAMILY_TEXTS), "doc_a").select(*rows.columns, "other", "texts")


def _covers(good: DataFrame) -> DataFrame:
    """``doc_id, covers``: passages of each text with hubs, those with the hubs of most texts first.

    A hub has a passage of its own, all of it.
    """
    zero, whole = F.lit(0).cast("long"), F.lit(WHOLE).cast("long")
    hubs = good.select("doc_a", "texts").distinct()
    own = hubs.select("doc_a", "texts", "doc_a", zero, whole, zero, whole, zero)
    held = good.select("doc_b", "texts", "doc_a", "start_a", "end_a", "start_b", "end_b", "other")
    names = ["texts", "hub", "hub_low", "hub_high", "low", "high", "other"]
    listed = held.toDF("doc_id", *names).union(own).groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("covers"))
    return listed.select("doc_id", F.slice(F.sort_array("covers", False), 1, COVERS).alias("covers"))


def shared_passages(docs: DataFrame) -> DataFrame:
    """``doc_a, doc_b, start_a, end_a, start_b, end_b, n_equal``: a row per shared passage.

    Places are words, the end exclusive; ``doc_a < doc_b``. Every text that shares a
    passage of ``LEAST_WORDS`` words or more, of which ``AGREE`` are equal and in
    order and ``LEAST_SEEDS`` seeds are the same, is in a row with each such partner, as measured
    at ``GROUP`` if words are replaced, or in the same class: then both are in a row with the
    class's first text, of which they hold the same ``CLASS_WORDS`` words in a row, or ``RUN_WORDS`` times one word. Or both are in a row
    with the same text, the hub, of ``FAMILY_TEXTS`` texts or more, and share the passage by these rows: of
    the ``n`` words of the hub in both, at least ``LEAST_WORDS`` and ``AGREE`` of the longer side are left
    without those in which either differs. Such a pair may have a row for a part of its passage. Takes ``doc_id`` and ``text``, whatever else there is. Null and short texts
    share nothing; rows without doc_id take no part, repeated rows count once. Several
    texts of one id are compared with other ids' texts each, not among themselves.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    texts, copies, several, n_texts = _copies(given)
    often = written(_often(texts, n_texts), "frequent-seeds")
    seeds = texts.mapInArrow(_seeds, SEEDS)
    met = [_matches(seeds, None if often.isEmpty() else often, "matches")]
    hubs = met[0].filter(F.col("kind") == HUB)
    if not often.isEmpty():
        met.append(_matches(hubs.select("seed", F.col("doc_a").alias("doc_id"), F.col("a").alias("place"), F.col("b").alias("reach")), None, "hub-matches"))
    # A pair has no more matches than its two texts have seeds.
    both = F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")
    pair = ["doc_a", "doc_b"]
    few_seed = F.when(F.col("seed") != 0, F.col("seed")).alias("seed")
    matches = functools.reduce(DataFrame.union, met).filter(F.col("kind") == MATCH).select(*pair, both.alias("both"), few_seed)
    grouped = matches.groupBy(*pair).agg(F.collect_list("both").alias("matches"), F.max("seed").alias("seed"))
    grouped = written(grouped, "pairs")
    found = _chains(grouped, "chains")
    words = written(texts.join(_ends(found), "doc_id", "left_semi").mapInArrow(_words, "doc_id long, words array<int>"), "words")
    first = _passages(found, words, "hub-passages")

    good = written(_good(first, several), "family-passages")
    # The seeds that many texts hold or that come again, and the seed of few texts of pairs with one match.
    again = (F.col("kind") == REPEATED) | (F.col("kind") == OFTEN) & (F.col("b") == 0)
    own = met[0].filter(again).select(F.col("doc_a").alias("doc_id"), "a", "seed", F.lit(False).alias("few"))
    single = grouped.filter((F.size("matches") == 1) & F.col("seed").isNotNull())
    for doc_id, place in (("doc_a", F.shiftright("_place", 32)), ("doc_b", F.col("_place").bitwiseAND(F.lit(PLACES)))):
        side = single.select(doc_id, "seed", F.col("matches")[0].alias("_place"))
        own = own.union(side.select(doc_id, place.cast("int"), "seed", F.lit(True)).distinct())
    own = own.groupBy("doc_id").agg(F.collect_list(F.struct("a", "seed", "few")).alias("own"))
    covers = _covers(good)
    own = own.filter(F.exists("own", lambda x: ~x["few"])).join(covers, "doc_id", "left")
    linked = own.mapInArrow(_linked, f"{LINKED}, {COVER}")
    further = _by_seed(linked.repartition("seed").sortWithinPartitions("seed", "doc_id", "place"), _met_linked, "linked-matches")
    run_texts = met[0].filter((F.col("kind") == OFTEN) & (F.col("b") > 0)).select(F.col("doc_a").alias("doc_id")).distinct()
    runs = texts.join(run_texts.hint("merge"), "doc_id").join(covers, "doc_id", "left").mapInArrow(_runs, RUNS)
    runs = _by_seed(runs.repartition("seed").sortWithinPartitions("seed", "doc_id", "place"), _met_runs, "run-matches")
    further = further.union(runs)
    # Pairs of texts with linked pairs are chained with all their matches.
    further = further.groupBy(*pair).agg(F.collect_set(both).alias("linked"))
    all_matches = F.concat("linked", F.coalesce("matches", F.array().cast("array<long>"))).alias("matches")
    again = further.join(grouped.drop("seed").hint("merge"), pair, "left").select(*pair, all_matches)
    found = _chains(again, "linked-chains")
    rest = _ends(found).join(words.select("doc_id"), "doc_id", "left_anti").hint("merge")
    more = written(texts.join(rest, "doc_id", "left_semi").mapInArrow(_words, "doc_id long, words array<int>"), "more-words")
    second = _passages(found, words.union(more), "linked-passages")
    # Passages that imply others stay as they are, and the rest of a pair's beside them.
    stay = good.select(*second.columns)
    one, two = second.alias("one"), stay.alias("two")
    meet = functools.reduce(Column.__and__, [F.col(f"one.{c}") == F.col(f"two.{c}") for c in pair])
    for side in ("a", "b"):
        meet &= (F.col(f"one.start_{side}") < F.col(f"two.end_{side}")) & (F.col(f"two.start_{side}") < F.col(f"one.end_{side}"))
    found_again = second.select(*pair).union(stay.select(*pair))
    alone = first.join(found_again, pair, "left_anti").select(*second.columns)
    return alone.union(stay).union(one.join(two, meet, "left_anti")).union(copies)
