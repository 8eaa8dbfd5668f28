"""Conversation repair, sharding and whitening against plain versions."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers_llm import AWKWARD, CLASHES, docs

from fieldloom.llm import audits, conversations, ring, whitening

# -- conversation repair --------------------------------------------------------


def plain_audit(rows):
    """The least (cost, audit) of all edits of rows (initial, fault), cheapest first."""
    keep = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
    heap, least = [(0, "", 0, "")], {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        # What costs more than another way here is dropped; of long ones also what costs as much.
        if least.setdefault((i, state), cost) < cost or (len(rows) > 12 and least.get((i, state, 0)) is not None):
            continue
        least[i, state, 0] = True
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        ways = []
        if not audit.endswith("II"):
            ways.append((5, "I", i, "a" if state == "u" else "u"))
        if i < len(rows):
            initial, fault = rows[i]
            ways.append((2, "D", i + 1, state))
            extra = 5 if fault == audits.TRUNCATED else 0
            if fault not in (audits.BLANK, audits.REPEATED):
                ways.append((1 + extra, "R", i + 1, "a" if state == "u" else "u"))
                if (initial, state) in keep:
                    ways.append((extra, "K", i + 1, keep[initial, state]))
        for more, letter, j, after in ways:
            if more or letter == "K":
                heapq.heappush(heap, (cost + more, audit + letter, j, after))


def random_rows(rng, most=9):
    return [(rng.choice("ssuuuaaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(most))]


@pytest.mark.parametrize("modulus", [audits.MODULUS, 3, 1])
def test_cheapest_audit_is_the_least_one(modulus):
    """With a small modulus nearly all hashes collide; letters decide then."""
    rng = random.Random(5)
    for _ in range(1200):
        rows = random_rows(rng)
        frontier = audits.Frontier(modulus=modulus)
        for initial, fault in rows:
            frontier.row(initial, fault)
        cost, audit = frontier.closed()
        assert (cost, str(audit)) == plain_audit(rows), rows


def test_stretches_join_to_the_same_audit():
    rng = random.Random(6)
    for _ in range(800):
        rows = [(i, f, rng.choice([1, 1, 1, 3])) for i, f in random_rows(rng, 14)]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randrange(4)))
        cost, pieces = audits.joined(
            audits.stretch(rows[a:b]) for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)
        )
        single = [(i, f if c == 0 else audits.REPEATED) if f != audits.BLANK else (i, f) for i, f, n in rows for c in range(n)]
        assert (cost, "".join(pieces)) == plain_audit(single)
        assert len(pieces) == len(cuts) + 1


def test_long_equal_beginnings_are_compared_in_logarithmic_steps():
    frontier = audits.Frontier()
    for _ in range(20_000):
        frontier.row("t", audits.FINE)
    cost, audit = frontier.closed()
    assert cost == 20_000 and str(audit) == "R" * 20_000


def plain_repair(rows):
    """The contract, row by row, from the rows before damage."""
    conversations_ = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = conversations_[conv]
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in conversations_.items():
        kept.sort()
        seen, faults = set(), []
        for *_, role, text in kept:
            body = text.rstrip(" \t\n\v\f\r")
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [role[:1] for *_, role, _ in kept]
        cost, audit = plain_audit(list(zip(initials, faults, strict=True)))
        turns = [turn for known, turn, *_ in kept if known]
        pairs = [a + b for a, b in zip(initials, initials[1:], strict=False)]
        done, rest, state = [], iter(kept), ""
        for letter in audit:
            given = next(rest) if letter != "I" else None
            if letter == "D":
                continue
            state = given[2][0] if letter == "K" else "a" if state == "u" else "u"
            role = given[2] if letter == "K" else {"u": "user", "a": "assistant"}[state]
            done.append(f"{role}:{given[3] if given else ''}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(n) for n in (1, 2, 3)),
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost,
            audit,
            hashlib.sha256("\n".join(done).encode()).hexdigest(),
        )
    return out


def conversation_rows():
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "why", " ", "", None, "so\t", "end. \n", "ünï?"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(9)):
            where = rng.choice([turn, turn, turn, turn * 2, None])
            text = rng.choice(texts)
            row = (conv, where, rng.choice(roles), text if rng.random() < 0.4 or text is None else f"{turn} {text}")
            rows += [row] * rng.choice([1, 1, 1, 1, 2])
    # One conversation with most of the rows, one very long text, and a text said very often.
    rows += [(77, t // 2, rng.choice(roles[:6]), f"{rng.randrange(40)} {rng.choice(texts)}") for t in range(90)]
    rows += [(78, t % 5, "user", "Again.") for t in range(400)] + [(79, 0, "user", "x " * 300_000 + ".")]
    return rows


@pytest.mark.parametrize("stretch_rows", [conversations.STRETCH_ROWS, 3])
def test_conversations_match_the_row_by_row_version(spark, stretch_rows):
    rows = conversation_rows()
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    given = given.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES.split()], "1 AS copies", "2 AS fault", "3 AS kind")
    found = conversations.repaired_conversations(conversations.damaged(given), stretch_rows).collect()
    assert {r.conv_id: tuple(r[1:]) for r in found} == plain_repair(rows)
    assert len(found) == len({r[0] for r in rows})


def test_conversations_without_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired_conversations(conversations.damaged(empty)).count() == 0
    gone = next(t for t in range(99) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = spark.createDataFrame([(5, gone, "user", "Hi.")], empty.schema)
    row = conversations.repaired_conversations(conversations.damaged(rows)).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    row = conversations.repaired_conversations(conversations.undamaged(rows)).first()
    assert (row.cost, row.audit) == (2, "D")


# -- sharding -------------------------------------------------------------------


def check_shards(found, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r.slot)
    counts = [len(by_shard[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_shards_of_awkward_rows(spark):
    check_shards(ring.sharded(docs(spark, AWKWARD)).collect(), AWKWARD, 8)
    assert ring.sharded(docs(spark, AWKWARD).limit(0)).count() == 0
    check_shards(ring.sharded(docs(spark, AWKWARD), shards=1).collect(), AWKWARD, 1)


def test_hot_rows_and_texts_fill_shards_evenly(spark):
    rows = [(1, "same row")] * 25_001 + [(i, "same text") for i in range(9_000)] + [(i, f"text {i}") for i in range(9_000)]
    found = ring.sharded(docs(spark, rows, extra=False)).collect()
    check_shards(found, rows, 8)
    # The copies fill several shards, each of them from its first free slot on.
    assert len({r.shard for r in found if (r.doc_id, r.size) == (1, 9)}) >= 5


def test_ring_follows_the_sequential_rule(spark):
    """Rows of one round enter arcs in clockwise order, as a plain loop over single rows has it."""
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    found = ring.sharded(docs(spark, rows, extra=False), shards=5, virtual=7)
    place = {t: p for t, p in spark.createDataFrame(rows, "i long, text string").selectExpr("text", "xxhash64(text) AS p").collect()}
    owner, arcs = ring.ring(5, 7)
    room = ring.capacities(len(rows), 5)
    order = sorted((int(arcs[(place[t] % 2**64) >> (64 - ring.RING_BITS)]), place[t], zlib.crc32(t.encode()), len(t), i, t) for i, t in rows)
    waiting = [(arc, row) for row in order for arc in [row[0]]]
    want = {}
    while waiting:
        onwards = []
        for arc, row in sorted(waiting, key=lambda w: w[0]):
            if room[owner[arc]]:
                room[owner[arc]] -= 1
                want[row[4]] = owner[arc]
            else:
                onwards.append(((arc + 1) % len(owner), row))
        waiting = onwards
    assert {r.doc_id: r.shard for r in found.collect()} == want


def test_equal_texts_stay_together_and_few_rows_move(spark):
    rows = [(i, f"text {i % 4000}") for i in range(12_000)]
    given = docs(spark, rows, extra=False)
    before, after = ({r.doc_id: (r.shard, r.text_crc32) for r in ring.sharded(given, n).collect()} for n in (8, 9))
    torn = len({(c, s) for s, c in before.values()}) - 4000
    assert torn <= 64
    moved = sum(before[i][0] != after[i][0] for i in before) / len(before)
    assert moved < 0.5  # a modulo would move 8 of 9
    loose = [{r.doc_id: r.shard for r in ring.sharded(given, n, slack=0.25).collect()} for n in (8, 9)]
    assert max(Counter(loose[0].values()).values()) <= 12_000 * 1.25 / 8 + 1
    assert sum(loose[0][i] != loose[1][i] for i in before) / len(before) < 0.3


# -- whitening ------------------------------------------------------------------


def plain_whitening(x, components):
    z = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / len(x))
    order = np.argsort(-values)[:components]
    return z @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def embedding_rows(count=300, width=12, seed=3):
    rng = np.random.default_rng(seed)
    spread = np.linspace(2, 0.2, width)
    return [(i, [float(v) for v in rng.normal(size=width) * spread]) for i in range(count)]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.selectExpr("*", "'x' AS component", "'y' AS n", "'z' AS i")


def test_whitening_matches_numpy(spark):
    good = embedding_rows()
    rows = good + [good[0]] * 40 + [(None, good[1][1]), (900, None), (901, []), (902, [1.0] * 11 + [None])]
    rows += [(903, [1.0] * 11 + [float("nan")]), (904, [1.0] * 11 + [float("inf")]), (905, [1.0, 2.0])]
    kept = good + [good[0]] * 40 + [(None, good[1][1])]
    found = whitening.whitened(vectors(spark, rows).repartition(4)).collect()
    assert Counter(r.vec_id for r in found) == Counter({k: 8 * n for k, n in Counter(i for i, _ in kept).items()})
    x = np.floor(1024 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    sums = x.sum(axis=0)
    want, explained = plain_whitening(x.astype(float), 8)
    place = {i: n for n, (i, _) in enumerate(kept)}
    got = np.array([[r.whitened for r in found if r.vec_id == i and r.component == c][:1] for i in place for c in range(1, 9)])
    got = got.reshape(len(place), 8)
    expected = want[list(place.values())]
    signs = np.sign((got * expected).sum(axis=0))
    assert np.allclose(got * signs, expected, atol=1e-9)
    for r in found:
        assert r.n == len(kept) and r.identity_error < 1e-9
        assert abs(r.explained - explained[r.component - 1]) < 1e-12
        assert int(r.deviation) == int(sum((len(kept) * int(a) - int(s)) ** 2 for a, s in zip(x[place[r.vec_id]], sums, strict=True)))
    digest = whitening.digest(whitening.whitened(vectors(spark, rows))).first()
    assert isinstance(digest.deviation, int)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert whitening.whitened(vectors(spark, rows)).count() == 0
    flat = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    assert {r.component for r in whitening.whitened(vectors(spark, flat)).collect()} == {1}


def test_large_entries_stay_exact():
    rng = np.random.default_rng(1)
    for bits in (10, 25, 40):
        y = rng.integers(-(1 << bits), 1 << bits, size=(300, 5))
        assert (whitening.products(y) == (y.astype(object).T @ y.astype(object))).all()


@pytest.mark.parametrize("rank", [1, 7, 30])
def test_eigenpairs_of_a_factored_scatter(rank):
    rng = np.random.default_rng(rank)
    half = rng.normal(size=(30, rank)) * np.logspace(0, -4, rank)
    values, directions = whitening.eigenpairs(half @ half.T)
    want = np.linalg.svd(half, compute_uv=False) ** 2
    assert np.allclose(values[: len(want)], want, rtol=1e-7)
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-9)
