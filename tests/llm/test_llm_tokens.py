"""Token ids, counts by spliced chunks, and packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers_llm import AWKWARD, docs
from tokenizers import Tokenizer

from fieldloom.llm.packing import fill, packed_documents, plan
from fieldloom.llm.token_counts import token_counts
from fieldloom.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def fuzzed(count):
    rng = random.Random(count)
    parts = [chr(c) for c in range(0x250)] + [" ", "  ", "\n", "'s", "'ll", SPECIAL, "日本", "😀", " ", "٣", "abc", "12"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(count)]


def test_ids_equal_the_library(library):
    texts = fuzzed(4000)
    assert [list(i) for i in encoder(PATH).ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_vocabulary_entry_alone(library):
    texts = [library.decode([i], skip_special_tokens=False) for i in range(library.get_vocab_size())]
    assert [list(i) for i in encoder(PATH).ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (500, 32)])
def test_counts_are_spliced_exactly(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    huge = ["".join(fuzzed(120)), SPECIAL * 40, "x" * 3000 + " y " + "z" * 900, " " * 700 + "a", "word " * 400, "<|endof" * 90]
    huge += ["".join(rng.choice(["a", " ", SPECIAL, "!!", "\n\n"]) for _ in range(800)) for _ in range(10)]
    rows = [*AWKWARD, *enumerate(huge, 100), (100, huge[0])]
    got = token_counts(docs(spark, rows), PATH, chunk=chunk, overlap=overlap).collect()
    texts = [t or "" for _, t in rows]
    sizes = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    want = [(d, len(t.encode()), n, n > 1024) for (d, _), t, n in zip(rows, texts, sizes, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_counts_of_no_rows(spark):
    assert token_counts(docs(spark, []), PATH).collect() == []


def check_packing(rows, library, texts, capacity):
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in [*pieces.values(), *sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(n for _, n in parts) == len(ids[k]) for k, parts in pieces.items())
    assert set(pieces) == set(texts)
    assert all(sum(n for _, n in s) <= capacity for s in sequences.values())
    return len(sequences), sum(map(len, ids.values()))


def test_packing_covers_all_ids(spark, library):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "b", "gamma delta"]) for _ in range(rng.randint(0, 300)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "long text " * 2000), (503, SPECIAL)]
    found = packed_documents(docs(spark, rows), PATH, capacity=128).collect()
    sequences, total = check_packing(found, library, dict(rows), 128)
    assert sequences <= 1.02 * total / 128 + 2
    assert packed_documents(docs(spark, []), PATH).collect() == []


def test_repeated_rows_are_packed_each(spark):
    found = packed_documents(docs(spark, AWKWARD), PATH).collect()
    assert sum(r.doc_id == 9 for r in found) == 2
    assert sum(r.start == 0 for r in found) == len(AWKWARD)


def test_fill_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        reach = {0}
        for length, count in counts.items():
            reach = {s + length * k for s in reach for k in range(count + 1)}
        picked = fill(counts, room)
        assert sum(n * k for n, k in picked.items()) == max(s for s in reach if s <= room)
        assert all(k <= counts[n] for n, k in picked.items())


def test_plan_deals_every_piece_once():
    rng = random.Random(6)
    counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(30)}
    dealt, fills = defaultdict(int), defaultdict(int)
    for length, low, high, sequence, each, _ in plan(counts, 64):
        assert low == dealt[length]
        dealt[length] = high
        for s in range((high - low) // each):
            fills[sequence + s] += each * length
    assert dict(dealt) == counts and max(fills.values()) <= 64
    assert set(fills) == set(range(len(fills)))
