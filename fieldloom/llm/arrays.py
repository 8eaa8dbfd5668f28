"""Words of whole Arrow batches as numpy arrays, without a Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z. Words, word groups and sets get
64-bit hashes: two different ones meet with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch: a batch of very long texts stays small.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
#: Bytes that one round of word hashing holds in wide arrays.
HASH_BYTES = 1 << 19

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def bound_batches(spark: SparkSession) -> None:
    """Have Spark send texts to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    out = values ^ (values >> np.uint64(30))
    out *= MIX_A
    out ^= out >> np.uint64(27)
    out *= MIX_B
    out ^= out >> np.uint64(31)
    return out


@functools.cache
def odd_constants(count: int, seed: int) -> np.ndarray:
    """Fixed odd multipliers."""
    steps = np.arange(1, count + 1, dtype=np.uint64) * BASE + np.uint64(seed)
    return mixed(steps) | np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    powers = []
    for factor in (BASE, inverse):
        row = np.full(count, factor, np.uint64)
        row[0] = 1
        powers.append(np.multiply.accumulate(row))
    return powers[0], powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text starts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """The words of some texts: byte ranges, hashes, and the text of each word.

    With ``letters``, a word is a run of ASCII letters, digits and bytes from 128 on.
    ``prefixes`` are byte lengths; the beginnings of words get hashes as well.
    """

    def __init__(self, column: pa.Array, letters: bool = False, prefixes: tuple[int, ...] = ()):
        self.raw, self.offsets = text_bytes(column)
        raw = self.raw
        self.lower = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        if letters:
            low = self.lower
            inside = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)) | (low >= 128)
        else:
            inside = (raw != 32) & ((raw < 9) | (raw > 13))
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(raw))]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.text_of = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.text_of, minlength=len(self.offsets) - 1)
        #: The first word of each text.
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        self.hashes, *self.prefixes = self._hashed(prefixes)

    def _hashed(self, prefixes: tuple[int, ...]) -> list[np.ndarray]:
        """Hashes of the words, and of their first bytes."""
        out = [np.empty(len(self.starts), np.uint64) for _ in range(1 + len(prefixes))]
        i = 0
        while i < len(self.starts):
            begin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, begin + HASH_BYTES, "right")))
            stop = self.ends[j - 1]
            powers, inverse = _powers(1 << int(stop - begin).bit_length())
            sums = np.zeros(stop - begin + 1, np.uint64)
            each = self.lower[begin:stop].astype(np.uint64) + np.uint64(1)
            np.cumsum(each * powers[: stop - begin], out=sums[1:])
            a, b = self.starts[i:j] - begin, self.ends[i:j] - begin
            for row, length in zip(out, (None, *prefixes), strict=True):
                until = b if length is None else np.minimum(b, a + length)
                row[i:j] = mixed((sums[until] - sums[a]) * inverse[a])
            i = j
        return out

    def groups(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every ``size`` words in a row, and the word each begins with.

        Groups do not cross texts. A text with fewer words has none.
        """
        last = len(self.hashes) - size + 1
        if last <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        whole = np.flatnonzero(self.text_of[:last] == self.text_of[size - 1 :])
        total = np.zeros(len(whole), np.uint64)
        for j, constant in enumerate(odd_constants(size, seed)):
            total += mixed(self.hashes[whole + j] ^ constant) * constant
        return mixed(total), whole

    def shingle_sets(self, size: int) -> Iterator[np.ndarray]:
        """Per text the sorted hashes of its distinct shingles.

        A text of fewer words has one shingle, all its words; an empty text has none.
        """
        hashes, begins = self.groups(size)
        bounds = np.searchsorted(begins, self.first)
        constants = odd_constants(size, 1)
        for text, count in enumerate(self.counts):
            if 0 < count < size:
                own = self.hashes[self.first[text] : self.first[text] + count]
                yield mixed(np.array([(mixed(own ^ constants[:count]) * constants[:count]).sum() + np.uint64(count)]))
            else:
                yield np.unique(hashes[bounds[text] : bounds[text + 1]])
