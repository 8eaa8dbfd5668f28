"""Chat formatting, top-k search and shared passages."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import AWKWARD, docs, words
from pyspark.sql import functions as F

from fieldloom.llm import chat_format, passages, topk
from fieldloom.llm.arrays import Words


def test_chats_are_read_back(spark):
    rng = random.Random(1)
    parts = ["<s>", "</s>", "<t>", "[INST]", "\\", "<", "[", "~", "=", "a", "\n", "</", "s>", "é", "<|x|>", "$1"]
    rows, source = [], {}
    for conv in range(300):
        turns = []
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "system", "", "a\nb<t>"])
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
            turns.append((role, text))
            rows.append((conv, turn, role, text))
        source[conv] = turns
    rows += [(900, None, None, None), (900, 1, "assistant", None), (None, 0, "user", "x"), (901, 0, "user", "r"), (901, 0, "user", "r")]
    source |= {900: [("", ""), ("assistant", "")], None: [("user", "x")], 901: [("user", "r"), ("user", "r")]}
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS rows", "2 AS turns")
    formatted = chat_format.formatted_conversations(given)
    for row in formatted.select("*", chat_format.read_turns(F.col("formatted")).alias("read")).collect():
        turns = source[row.conv_id]
        assert [tuple(t) for t in row["read"]] == turns
        learned = [t for r, t in turns if r == "assistant"]
        spans = [row.formatted[s["start"] : s["start"] + s["length"]] for s in row.loss]
        signs = [row.formatted[s["start"] - 1] for s in row.loss]
        assert [s if g == "=" else chat_unescape(s) for s, g in zip(spans, signs, strict=True)] == learned
    read = {r.conv_id: r for r in chat_format.digest(formatted).collect()}
    assert read[900].n_turns == 2 and read[900].loss_chars == 0
    assert chat_format.formatted_conversations(given.limit(0)).collect() == []


def chat_unescape(text):
    out, i = [], 0
    while i < len(text):
        out.append(text[i])
        i += 2 if text[i] in "<[\\" else 1
    return "".join(out)


def test_only_conflicting_chats_are_escaped(spark):
    rows = [(1, 0, "user", "plain [INST] < \\"), (2, 0, "user", "</s>[INST]")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = dict(chat_format.formatted_conversations(given).select("conv_id", "formatted").collect())
    assert got == {1: "<s>user<t>=plain [INST] < \\</s>", 2: "<s>user<t>~<\\/s>[\\INST]</s>"}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 16)).round(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(i, rows[3][1]) for i in range(400, 430)]
    rows += [(430, None), (431, [1.0, None]), (432, [float("nan")] * 16), (433, [float("inf")] * 16), (434, []), (440, [2.0]), (None, rows[1][1])]
    rows += [rows[20], (41, rows[5][1])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "2 AS score")
    got = topk.top_k(given, F.col("vec_id") % 20 == 0, k=7, shard_rows=90).collect()
    whole = [(i, np.floor(64 * np.array([*v, *[0.0] * (16 - len(v))]))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for query, q in {(i, tuple(q)): (i, q) for i, q in whole if i % 20 == 0}.values():
        best = sorted((-int(q @ v), i) for i, v in whole if i != query)[:7]
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(given.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_shards_of_large_numbers_stay_exact():
    vectors = np.array([[2**40, 1], [2**40, 2], [2**40, 3]])
    found = list(topk.shard_top(np.array([9]), vectors[:1], np.array([1, 2, 3]), vectors, 2))
    assert found[0][1].tolist() == [3, 2]


def test_kept_seeds_are_the_window_minima():
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "", "one two", "z y x w v u t s r q p o n m l k j i h g f e d c b a"]
    parsed = Words(pa.array(texts))
    hashes, begins = parsed.groups(3)
    text_of = parsed.text_of[begins]
    want = set()
    for text in range(len(texts)):
        own = np.flatnonzero(text_of == text)
        for i in range(len(own) - passages.SPREAD + 1):
            window = own[i : i + passages.SPREAD]
            want.add(int(window[hashes[window].argmin()]))
    assert set(passages.kept_seeds(hashes, text_of).tolist()) == want


def test_chains_have_the_best_scores():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n = int(rng.integers(1, 14))
        pairs = np.unique(rng.integers(0, 60, (n, 2)), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
        score = []
        for i in range(len(a)):
            before = [
                score[j] - passages.GAP_COST * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i]
            ]
            score.append(1 + max([0, *before]))
        best = passages.chains(a, b)
        if max(score) >= passages.LEAST_SEEDS - 0.5:
            chain = best[0]
            gaps = sum(a[y] - a[x] + b[y] - b[x] for x, y in zip(chain, chain[1:], strict=False))
            assert np.isclose(len(chain) - passages.GAP_COST * gaps, max(score))
        for chain in best:
            assert all(a[x] < a[y] and b[x] < b[y] for x, y in zip(chain, chain[1:], strict=False))


def test_planted_passages_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    common, line = text(80), text(14)
    rows, want = [], set()
    for i in range(120):
        own = text(rng.randint(60, 200))
        if i % 3 == 0:
            copy = [w if rng.random() > 0.03 else rng.choice(vocabulary) for w in common]
            own = own[:30] + copy + own[30:]
            want.add(i)
        elif i % 3 == 1:
            own = own[:30] + line + own[30:]
        rows.append((i, " ".join(own)))
    found = passages.shared_passages(docs(spark, [*rows, *AWKWARD])).collect()
    ids = {d for r in found for d in (r.doc_a, r.doc_b)}
    assert ids == want | {7, 8}
    texts = {d: words(t) for d, t in rows}
    for r in found:
        if r.doc_a in want and r.doc_b in want:
            assert r.doc_a < r.doc_b and abs((r.end_a - r.start_a) - 80) <= 25
            assert r.n_equal <= min(r.end_a - r.start_a, r.end_b - r.start_b)
            assert r.end_a <= len(texts[r.doc_a])
    assert passages.shared_passages(docs(spark, [])).collect() == []


@pytest.mark.parametrize("holders", [1, 6])
def test_partial_holders_do_not_hide_a_passage(spark, holders):
    """Texts with a part of a passage have the smallest and greatest ids."""
    rng = random.Random(holders)
    vocabulary = [f"v{i}" for i in range(5000)]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    for _ in range(3 if holders == 1 else 1):
        passage = text(80)
        rows = [(i, " ".join([*text(30), *passage, *text(30)])) for i in (500, 600)]
        for part, low in enumerate((0, 20, 40)):
            for i in range(holders):
                for doc_id in (1 + part + 3 * i, 990 + part + 3 * i):
                    rows.append((doc_id, " ".join([*text(30), *passage[low : low + 40], *text(30)])))
        found = passages.shared_passages(docs(spark, rows)).collect()
        assert (500, 600) in {(r.doc_a, r.doc_b) for r in found}
        assert all(r.end_a - r.start_a >= 45 for r in found)


def brute_passage(a, b):
    """Whether two word lists have a long enough passage without shifts that agrees enough."""
    for shift in range(-len(b) + 45, len(a) - 44):
        same = [x == y for x, y in zip(a[max(0, shift) :], b[max(0, -shift) :], strict=False)]
        sums = np.concatenate(([0], np.cumsum(same)))
        for n in range(45, len(same) + 1):
            if (sums[n:] - sums[:-n] >= passages.AGREE * n).any():
                return True
    return False


def test_fuzzy_passages_are_found(spark):
    """Recall against brute force for 50 words of which 10 to 25 % are replaced."""
    rng = random.Random(13)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    rows, want = [], {}
    for i in range(0, 800, 2):
        share = (0.1, 0.15, 0.2, 0.25)[i // 2 % 4]
        passage = text(50)
        copy = [w if rng.random() >= share else text(1)[0] for w in passage]
        a, b = text(30) + passage + text(30), text(40) + copy + text(20)
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        if brute_passage(a, b):
            want.setdefault(share, set()).add((i, i + 1))
    found = {(r.doc_a, r.doc_b) for r in passages.shared_passages(docs(spark, rows)).collect()}
    recall = {share: len(pairs & found) / len(pairs) for share, pairs in want.items()}
    print(recall, {share: len(pairs) for share, pairs in want.items()})
    assert min(recall.values()) >= 0.95 and found <= set.union(*want.values())


@pytest.mark.parametrize("part", [32, 40])
def test_fuzzy_pairs_behind_partial_holders(spark, part):
    """Pairs of 80 words with 8 % replaced per side; six texts on both ends of the ids hold parts of each."""
    rng = random.Random(part)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    def worn(passage):
        return [w if rng.random() >= 0.08 else text(1)[0] for w in passage]

    rows, want = [], set()
    for i in range(40):
        passage, pair = text(80), (10_000 + 2 * i, 10_001 + 2 * i)
        sides = {doc_id: text(30) + worn(passage) + text(30) for doc_id in pair}
        rows += [(doc_id, " ".join(own)) for doc_id, own in sides.items()]
        if brute_passage(*sides.values()):
            want.add(pair)
        for k in range(6):
            low = (0, 20, 80 - part)[k % 3]
            for doc_id in (20 * i + k, 20_000 + 20 * i + k):
                rows.append((doc_id, " ".join(text(30) + passage[low : low + part] + text(30))))
    found = {(r.doc_a, r.doc_b) for r in passages.shared_passages(docs(spark, rows)).collect()}
    texts = {d for pair in found for d in pair}
    print(len(want), len(want & found), len({d for pair in want for d in pair} - texts))
    assert len(want) >= 36 and len(want & found) >= 0.95 * len(want)


def test_stretches_that_repeat_are_shared(spark):
    """Two texts share nothing but a stretch of one, two or four words over and over."""
    rng = random.Random(6)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    rows, want = [], set()
    for i, period in enumerate((["z"], ["y", "x"], ["w", "v", "u", "t"], ["s", "r", "q"])):
        for side in range(2):
            rows.append((2 * i + side, " ".join(text(30 + 7 * side) + (period * 90)[side : 60 + 9 * side] + text(30))))
        want.add((2 * i, 2 * i + 1))
    found = passages.shared_passages(docs(spark, rows)).collect()
    assert {(r.doc_a, r.doc_b) for r in found} == want
    assert all(r.n_equal >= 45 for r in found)


def test_fuzzy_pairs_of_frequent_words_are_found(spark):
    """Pairs of 50 words with 20 % replaced; ten texts each hold the first and the last 30 words."""
    rng = random.Random(21)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    rows, want = [], set()
    for i in range(120):
        passage, pair = text(50), (10_000 + 2 * i, 10_001 + 2 * i)
        sides = (text(30) + passage + text(30), text(40) + [w if rng.random() >= 0.2 else text(1)[0] for w in passage] + text(20))
        rows += [(doc_id, " ".join(own)) for doc_id, own in zip(pair, sides, strict=True)]
        if brute_passage(*sides):
            want.add(pair)
        for k in range(20):
            doc_id = (20_000 if k % 4 < 2 else 0) + 20 * i + k
            rows.append((doc_id, " ".join(text(20) + (passage[:30] if k % 2 else passage[20:]) + text(20))))
    found = {(r.doc_a, r.doc_b) for r in passages.shared_passages(docs(spark, rows)).collect()}
    print(len(want), len(want & found))
    assert len(want) >= 90 and len(want & found) >= 0.94 * len(want)


def test_a_rare_and_a_frequent_seed_make_a_pair(spark):
    """Of each pair's same seeds all but one are frequent; the frequent ones lie within ten words."""
    rng = random.Random(17)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    def seeds(own):
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1]), "text": pa.array([" ".join(own)])})
        (found,) = passages._seeds(iter([batch]))
        return dict(zip(found["place"].to_pylist(), found["seed"].to_pylist(), strict=True))

    rows, want = [], set()
    while len(want) < 40:
        i = len(want)
        line = text(12)
        passage = text(20) + line + text(18)
        a = text(30) + passage + text(30)
        b = text(30) + [w if 20 <= k < 32 or rng.random() >= 0.3 else text(1)[0] for k, w in enumerate(passage)] + text(30)
        one, two = seeds(a), seeds(b)
        same = [p for p in one if one[p] == two.get(p)]
        rare = [p for p in same if not 50 <= p <= 58]
        if len(rare) == 1 and len(same) > 1 and brute_passage(a, b):
            want.add((10_000 + 2 * i, 10_001 + 2 * i))
            rows += [(10_000 + 2 * i, " ".join(a)), (10_001 + 2 * i, " ".join(b))]
            rows += [(20 * i + k + 20_000 * (k % 2), " ".join(text(20) + line + text(20))) for k in range(12)]
    found = {(r.doc_a, r.doc_b) for r in passages.shared_passages(docs(spark, rows)).collect()}
    assert found == want


def test_every_pair_of_a_fuzzy_family_is_found(spark):
    """Fourteen worn copies of 60 words: all pairs meet, not only those with the first and the last text."""
    rng = random.Random(3)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    sides, want = {}, set()
    for family in range(6):
        passage = text(60)
        ids = range(100 * family, 100 * family + 14)
        for doc_id in ids:
            sides[doc_id] = text(30) + [w if rng.random() >= 0.06 else text(1)[0] for w in passage] + text(30)
        want |= {(a, b) for a, b in itertools.combinations(ids, 2) if brute_passage(sides[a], sides[b])}
    rows = [(doc_id, " ".join(own)) for doc_id, own in sides.items()]
    found = {(r.doc_a, r.doc_b) for r in passages.shared_passages(docs(spark, rows)).collect()}
    runs = {d: {tuple(own[i : i + passages.CLASS_WORDS]) for i in range(len(own) - passages.CLASS_WORDS + 1)} for d, own in sides.items()}

    def classed(a, b):
        return any((h, a) in found and (h, b) in found and runs[a] & runs[b] & runs[h] for h in sides)

    lost = [pair for pair in want - found if not classed(*pair)]
    print(len(want), len(want & found), len(lost))
    assert len(lost) <= 0.02 * len(want) and found <= want


def test_links_of_a_large_family_follow_from_its_hub(spark):
    """Of thirty worn copies of 150 words each pair is in a row, or two rows with one text imply it."""
    rng = random.Random(5)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    passage, sides = text(150), {}
    for doc_id in range(30):
        sides[doc_id] = text(20) + [w if rng.random() >= 0.04 else text(1)[0] for w in passage] + text(20)
    rows = passages.shared_passages(docs(spark, [(doc_id, " ".join(own)) for doc_id, own in sides.items()])).collect()
    found, held = {(r.doc_a, r.doc_b) for r in rows}, {}
    for r in rows:
        other = max(r.end_a - r.start_a, r.end_b - r.start_b) - r.n_equal
        held.setdefault(r.doc_b, []).append((r.doc_a, r.start_a, r.end_a, other))

    def follows(a, b):
        for (h, s, e, n), (k, t, f, m) in itertools.product(held.get(a, []), held.get(b, [])):
            both = min(e, f) - max(s, t)
            if h == k and both - n - m >= max(passages.LEAST_WORDS, passages.AGREE * (both + max(n, m))):
                return True
        return False

    pairs = list(itertools.combinations(sides, 2))
    assert all(brute_passage(sides[a], sides[b]) for a, b in pairs)
    assert all(pair in found or follows(*pair) for pair in pairs)
    print(len(pairs), len(found))
    assert len(found) < len(pairs) / 2


def test_implied_links_need_enough_equal_words():
    """Overlap 100: 9 other words on both sides leave 82 of at most 109; 10 leave 80 of 110, which is too few."""
    for other, far, hub, want in ((9, 0, 1, True), (10, 0, 1, False), (9, 18, 1, True), (9, 19, 1, False), (9, 0, 2, False), (-1, 0, 1, False)):
        cover = [np.array(c) for c in ([1, hub], [50, 50 + far], [0, 20], [120, 130], [other, other])]
        assert passages.implied(cover, np.array([0]), np.array([1])).tolist() == [want]


def test_linked_pairs_meet_all_texts_but_those_of_a_class(monkeypatch):
    """Over any cut into batches each two texts meet, or both meet the first text of their class."""
    rng = random.Random(8)
    names = ["seed", "doc_id", "place", "reach", "held"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    monkeypatch.setattr(passages, "CELLS", 30)
    for _ in range(80):
        rows = []
        for seed in range(rng.randint(0, 5)):
            for doc in rng.sample(range(60), rng.choice([1, 2, 8, 9, 30])):
                rows += [(seed, doc, place, 15, rng.choice([0, 0, 7, 7, 7, 8])) for place in rng.sample(range(0, 250, 5), rng.choice([1, 1, 2]))]
        rows.sort()
        batches, i = [], 0
        while i < len(rows):
            j = i + rng.choice([1, 5, 40])
            columns = [pa.array([r[k] for r in rows[i:j]], kind) for k, kind in enumerate(types)]
            batches.append(pa.RecordBatch.from_arrays(columns, names))
            i = j
        got = [(r["doc_a"], r["doc_b"], r["a"], r["b"]) for b in passages._met_linked(iter(batches)) for r in b.to_pylist()]
        met = set(got)
        assert all(a < b for a, b, _, _ in met)
        for seed in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == seed]
            first = {}
            for _, doc, place, _, _ in own:
                first.setdefault(doc, place)
            for (_, a, x, _, held_a), (_, b, y, _, held_b) in itertools.combinations(own, 2):
                if a == b or (x != first[a] and y != first[b]):
                    continue
                if (a, b, x, y) in met and (a, b, x + 15, y + 15) in met:
                    continue
                assert len(first) > passages.FEW_TEXTS
                kinds = [{(r[4], r[2]) for r in own if r[1] == doc and r[4]} for doc in (a, b)]
                shared = {k for k, _ in kinds[0]} & {k for k, _ in kinds[1]}

                def meets(head, doc, kind):
                    return doc == head[1] or any((head[1], doc, head[2], p) in met for k, p in kinds[doc == b] if k == kind)

                assert any(r[4] in shared and meets(r, a, r[4]) and meets(r, b, r[4]) for r in own)


def reference_matches(rows):
    """All pairs of up to eight texts of a seed, else those with its first and last text."""
    met, often, by_seed = set(), set(), {}
    for seed, _, doc, place, _ in rows:
        by_seed.setdefault(seed, {}).setdefault(doc, []).append(place)
    for seed, texts in by_seed.items():
        many = len(texts) > passages.FEW_TEXTS
        for a, b in itertools.combinations(sorted(texts), 2):
            if not many or a == min(texts):
                met |= {(a, b, min(texts[a]), q) for q in texts[b]}
            if not many or (b == max(texts) and a != min(texts)):
                met |= {(a, b, p, min(texts[b])) for p in texts[a]}
        if many:
            often |= {(doc, place, seed) for doc, places in texts.items() for place in places}
    return met, often


def test_stretches_of_one_word_meet_their_class(monkeypatch):
    """Stretches of one word by 9 to 40 texts: each two that share a passage by them meet, or both meet the class's first text."""
    rng = random.Random(12)
    for trial in range(25):
        texts = {}
        for doc in range(rng.randint(9, 40)):
            around = [[f"u{rng.randrange(4)}" for _ in range(rng.choice([0, 3, 20, 70]))] for _ in range(2)]
            texts[doc] = around[0] + ["z"] * rng.choice([16, 25, 30, 34, 36, 44, 45, 60, 90]) + around[1]
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(list(texts)), "text": pa.array([" ".join(t) for t in texts.values()])})
        cover = pa.array([[]] * len(texts), pa.list_(pa.struct([(n, pa.int64()) for n in ("hub", "hub_low", "hub_high", "low", "high", "other")])))
        runs = pa.Table.from_batches(passages._runs(iter([batch.append_column("covers", cover)])))
        runs = runs.sort_by([("seed", "ascending"), ("doc_id", "ascending"), ("place", "ascending")]).combine_chunks()
        monkeypatch.setattr(passages, "RUN_PAIRS", rng.choice([5, 1 << 14]))
        met = [r for b in passages._met_runs(iter(runs.to_batches(max_chunksize=rng.choice([1, 7, 1000])))) for r in b.to_pylist()]
        for r in met:
            assert texts[r["doc_a"]][r["a"] : r["a"] + 4] == texts[r["doc_b"]][r["b"] : r["b"] + 4]
        pairs = {(r["doc_a"], r["doc_b"]) for r in met}
        assert all(a < b for a, b in pairs) and len(pairs) <= len(texts) * (len(texts) - 1) // 2
        long = {d: t.count("z") for d, t in texts.items()}
        for a, b in itertools.combinations(texts, 2):
            begins = [texts[d].index("z") for d in (a, b)]
            rooms = [(min(45, len(texts[d]) - i) == 45, i + long[d] >= 45) for d, i in zip((a, b), begins, strict=True)]
            heads = [h for h in texts if long[h] >= 34 and all(d == h or (min(d, h), max(d, h)) in pairs for d in (a, b))]
            if min(long[a], long[b]) >= 34 and (rooms[0][0] and rooms[1][0] or rooms[0][1] and rooms[1][1]):
                assert (a, b) in pairs or heads
            elif min(long[a], long[b]) < 34 or not any(rooms[0]) or not any(rooms[1]):
                for shift in {begins[0] - begins[1], begins[0] + long[a] - begins[1] - long[b]}:
                    x, y = texts[a][max(0, shift) :], texts[b][max(0, -shift) :]
                    same = np.concatenate(([0], np.cumsum([u == v for u, v in zip(x, y, strict=False)])))
                    if any((same[n:] - same[:-n] >= 0.75 * n).any() for n in range(45, min(64, len(same)))):
                        assert (a, b) in pairs


def test_families_of_one_word_make_few_rows(spark):
    """Sixty texts with 50 to 109 times one word are in a row with the first of them, not all with each other."""
    rng = random.Random(4)
    rows = [(i, " ".join([f"v{rng.randrange(20000)}" for _ in range(40)] + ["z"] * (50 + i) + [f"v{rng.randrange(20000)}" for _ in range(40)])) for i in range(60)]
    found = passages.shared_passages(docs(spark, rows)).collect()
    assert {r.doc_b for r in found if r.doc_a == 0} == set(range(1, 60))
    assert len(found) < 400


def test_matches_of_ordered_seeds(monkeypatch):
    """Matches over any cut into batches against a plain version; blocks of a long seed meet its first text."""
    rng = random.Random(1)
    names, types = ["seed", "part", "doc_id", "place", "reach"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    for trial in range(120):
        block = 12 if trial % 3 == 0 else 50_000
        monkeypatch.setattr(passages, "BLOCK", block)
        rows = []
        for seed in range(rng.randint(0, 6)):
            for doc in rng.sample(range(40), rng.choice([1, 2, 3, 8, 9, 25])):
                for place in rng.sample(range(50), rng.choice([1, 1, 3])):
                    rows += [(seed, 0, doc, place, 0)] * rng.choice([1, 1, 2])
        rows.sort()
        batches, i = [], 0
        while i < len(rows):
            j = i + rng.choice([1, 5, 40])
            columns = [pa.array([r[k] for r in rows[i:j]], kind) for k, kind in enumerate(types)]
            batches.append(pa.RecordBatch.from_arrays(columns, names))
            i = j
        got, often = set(), set()
        for row in (r for b in passages._met(iter(batches)) for r in b.to_pylist()):
            if row["kind"] == passages.MATCH:
                got.add((row["doc_a"], row["doc_b"], row["a"], row["b"]))
            elif row["kind"] == passages.OFTEN:
                often.add((row["doc_a"], row["a"], row["seed"]))
        want, want_often = reference_matches(rows)
        if block > 12:
            assert (got, often) == (want, want_often)
        else:
            assert often >= want_often


def test_straight_chains_align_alike():
    """Chains without shifts give the same passages by marks of equal words as by the general way."""
    rng = random.Random(2)
    for _ in range(800):
        size = rng.choice([6, 60, 5000])
        a = [rng.randrange(size) for _ in range(rng.randint(20, 160))]
        worn = [w if rng.random() > rng.choice([0, 0.1, 0.3]) else rng.randrange(size) for w in a]
        before = rng.randint(0, 30)
        b = [rng.randrange(size) for _ in range(before)] + worn
        seeds = sorted(rng.sample(range(len(a) - passages.GROUP + 1), rng.randint(2, 8)))
        want = passages.align(a, b, seeds, [i + before for i in seeds])
        x, y = np.array(a), np.array(b)
        assert passages.align_straight(x, y, np.array(seeds), before) == want
        back = passages.align(b, a, [i + before for i in seeds], seeds)
        assert passages.align_straight(y, x, np.array(seeds) + before, -before) == back


def test_frequent_seeds_are_dealt_to_parts(spark, monkeypatch):
    """With small parts each copy still has a partner and the copies hang together."""
    monkeypatch.setattr(passages, "PART_TEXTS", 12)
    rng = random.Random(3)

    def text(n):
        return [f"v{rng.randrange(20000)}" for _ in range(n)]

    passage = text(70)
    rows = [(i, " ".join(text(20) + passage + text(20))) for i in range(150)]
    rows += [(i, " ".join(text(90))) for i in range(150, 300)]
    found = {(r.doc_a, r.doc_b) for r in passages.shared_passages(docs(spark, rows)).collect()}
    assert {d for pair in found for d in pair} == set(range(150))
    group = {0}
    for _ in range(150):
        group |= {d for pair in found if group & set(pair) for d in pair}
    assert group == set(range(150))


def test_copies_and_repeated_rows_of_passages(spark):
    rng = random.Random(4)
    long, short, other = (" ".join(f"v{rng.randrange(20000)}" for _ in range(n)) for n in (60, 20, 70))
    rows = [(5, long), (3, long), (3, long), (9, long), (4, short), (6, short), (8, other), (8, other), (8, other), (None, long)]
    found = passages.shared_passages(docs(spark, rows)).collect()
    assert sorted(map(tuple, found)) == [(3, 5, 0, 60, 0, 60, 60), (3, 9, 0, 60, 0, 60, 60)]


def test_repeated_vectors_are_one_row_of_a_shard(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(61, [3.0, 4.0])] * 500 + [(62, [6.0, 1.0])] * 3
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept, write = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, purpose: kept.setdefault(purpose, write(df, purpose)))
    got = topk.top_k(given, F.col("vec_id") % 20 == 0, k=7, shard_rows=20).collect()
    want = []
    for query in (0, 20, 40):
        q = rows[query][1]
        best = sorted((-int(64 * 64 * (q[0] * v[0] + q[1] * v[1])), i) for i, v in rows if i != query)[:7]
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert kept["shards"].agg(F.sum(F.size("vectors"))).first()[0] == 62


def test_shards_and_blocks_meet_without_copies(spark, monkeypatch):
    """Many shards and blocks: a query's hits are ``k`` per group of shards, and no shard or block is moved once for each other."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(600, 8)).round(2)
    given = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    kept, write = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, purpose: kept.setdefault(purpose, (write(df, purpose), df))[0])
    got = topk.top_k(given, F.col("vec_id") % 4 == 0, k=5, shard_rows=10).collect()
    whole = np.floor(64 * vectors)
    want = []
    for query in range(0, 600, 4):
        best = sorted((-int(whole[query] @ v), i) for i, v in enumerate(whole) if i != query)[:5]
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    found, plan = kept["found"]
    assert kept["shards"][0].count() >= 40 and found.count() < 150 * 5 * 10
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and "sequence" not in plan


def test_wide_vectors_make_small_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BYTES", 8 * 50 * 4)
    kept, write = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, purpose: kept.setdefault(purpose, write(df, purpose)))
    given = spark.createDataFrame([(i, [float(i % 9)] * 50) for i in range(200)], "vec_id long, embedding array<double>")
    assert topk.top_k(given, F.col("vec_id") % 50 == 0, k=3).count() == 12
    assert kept["shards"].count() > 30
