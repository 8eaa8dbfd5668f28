"""Classifiers, the tagger and the leak search: planted cases, held-out rows, awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import AWKWARD, docs
from pyspark.sql import functions as F

from fieldloom.llm import decontamination, pii, quality, tagger, toxicity
from fieldloom.llm.samples import labelled_sample, taken

SF_DIR = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def test_toxic_words_are_learned(spark):
    rng = random.Random(1)
    clean = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(clean) for _ in range(40)]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 5) if bad else 0):
            text[rng.randrange(40)] = rng.choice(["grumbles", "snarkly", "vilest"])
        rows.append((i, " ".join(text)))
        if i < 200:
            labels.append((i, int(bad)))
    labels += [(None, 1), (7, None)]
    given = docs(spark, [*rows, *AWKWARD])
    model = toxicity.fit_toxicity(given, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (np.diff(model.thresholds) > 0).all()
    found = toxicity.toxic_documents(given, model).collect()
    assert len(found) == len(rows) + len(AWKWARD)
    unseen = [(r.toxic, r.doc_id % 5 == 0) for r in found if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert all(a == b for a, b in unseen)
    assert all(0 <= r.severity <= toxicity.GRADES for r in found)
    assert toxicity.without_toxic(given, model).columns == given.columns
    assert toxicity.toxic_documents(docs(spark, []), model).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs(spark, AWKWARD), none)
    assert not any(r.toxic for r in toxicity.toxic_documents(docs(spark, AWKWARD), model).collect())


def test_ordinal_fit_orders_severity():
    columns = np.array([0, 1, 0, 1, 2, 0, 1, 2] * 20)
    rows = np.repeat(np.arange(80), [0, 1, 3, 4] * 20)
    columns = np.concatenate([[0], [0, 1, 2], [0, 1, 2, 3]] * 20)
    weights, thresholds = toxicity.fit_thresholds(rows, columns, np.array([0, 1, 2, 3] * 20), np.ones(4))
    scores = np.bincount(rows, weights[columns], 80).reshape(20, 4)
    assert (np.diff(thresholds) > 0).all() and (np.diff(scores, axis=1) > 0).all()


def test_quality_holds_on_held_out_rows(spark):
    given, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.fit_quality(given, labels.filter(~quality.held_out(F.col("doc_id"))))
    rows = quality.scored(given, model).filter("held_out").join(labels.drop("toxic"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    found = quality.scored(docs(spark, AWKWARD), model).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert not any(r.held_out for r in found if r.doc_id is None)
    assert quality.scored(docs(spark, []), model).collect() == []


def test_quality_without_labels(spark):
    model = quality.fit_quality(docs(spark, AWKWARD), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.scored(docs(spark, AWKWARD), model).collect()} == {0.5}


def plain_spans(text):
    """The patterns as they are stated, by a plain regex engine."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [(m.start(), 1, m.end())] if all(int(p) <= 255 for p in m.group().split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
        out += [(m.start(), 2, m.end())] if 12 <= len(digits) <= 19 and total % 10 == 0 else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [(m.start(), 3, m.end())] if 9 <= sum(c in "0123456789" for c in m.group()) <= 15 else []
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["a", "B.", "@", "x@y.z", "@a-b.c", "1", "23", ".", "255", "256", "0001", "-", " ", "+", "+1 (2", ")", "é", "\n"]
    parts += ["4539578763621486", "+49 170 1234567", "a@b", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(a, pii.KINDS.index(k), b) for a, b, k in pii.base_spans(text)] == plain_spans(text), text


def test_long_runs_are_linear():
    for text in ("a" * 200_000, "a." * 100_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.fit_pii(table(spark, "documents"), steps=160)


def test_tagger_finds_base_spans_by_itself(spark, pii_model):
    texts = [r["text"] for r in table(spark, "documents").filter("text rlike '[0-9@]'").collect()]
    base = [pii.base_spans(t) for t in texts]
    alone = pii.added_spans(texts, [[] for _ in texts], pii_model.params)
    hits = sum(len(set(a) & set(b)) for a, b in zip(alone, base, strict=True))
    assert hits >= 0.9 * sum(map(len, base))
    assert hits >= 0.85 * sum(map(len, alone))


def test_pii_rows_and_redaction(spark, pii_model):
    rows = [*AWKWARD, (50, "x " * 40 + "mail a.b@mail.example.com now"), (51, "ip 10.1.2.3, card 4539578763621486")]
    found = {r.doc_id: r for r in pii.digest(pii.personal_data(docs(spark, rows), pii_model)).collect()}
    assert found[50].n_email == 1 and "email:85:105" in found[50].spans
    assert (found[51].n_ip, found[51].n_card) == (1, 1)
    assert found[2].spans == "" and found[1].base_sha256 == found[2].base_sha256
    text = pii.redacted(F.col("text"), pii_model)
    clean = dict(docs(spark, rows).select("doc_id", text).collect())
    assert clean[51] == "ip <IP>, card <CARD>" and clean[1] is None and clean[7] == dict(rows)[7]
    assert pii.personal_data(docs(spark, []), pii_model).collect() == []


def test_spans_across_windows(pii_model):
    for shift in range(0, 2 * pii.STEP, 5):
        text = "b" * shift + " someone.long.name@mail.example.com end"
        base, added = pii.find([text], pii_model.params)[0]
        assert len(base) == 1 and added == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    move = rng.normal(size=(3, 3))
    scores = [rng.normal(size=(n, 3)) for n in (4, 1, 6, 4)]
    for score, path in zip(scores, tagger.best_tags(scores, move), strict=True):
        def value(p, s=score):
            return s[np.arange(len(p)), p].sum() + move[p[:-1], p[1:]].sum()

        every = np.stack(np.meshgrid(*[range(3)] * len(score), indexing="ij"), -1).reshape(-1, len(score))
        assert np.isclose(value(path), max(value(p) for p in every))


def test_tagger_gradients():
    rng = np.random.default_rng(5)
    params = tagger.fresh(3)
    chars, tags = rng.integers(0, tagger.CLASSES, (2, 5)), rng.integers(0, 3, (2, 5))

    def loss():
        return tagger._crf(tagger.emissions(chars, params), params["move"], tags)[0]

    _, d_scores, _ = tagger._crf(tagger.emissions(chars, params), params["move"], tags)
    runs = {s: tagger._lstm(chars, params, s, keep=True) for s in "fb"}
    d_joint = d_scores @ params["out"].T
    grads = tagger._lstm_back(chars, params, "f", runs["f"][1], d_joint[:, :, : tagger.HIDDEN])
    before = loss()
    params["hf"][2, 3] += 1e-5
    assert np.isclose((loss() - before) / 1e-5, grads["hf"][2, 3], atol=1e-4)


def lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_common_subsequence_equals_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert decontamination.common_subsequence(decontamination.places(tuple(a)), len(a), b) == lcs(a, b)


def test_planted_leaks_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    frequent = ["the", "of", "and", "in"]

    def text(n):
        return [rng.choice(frequent) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]

    items = [(i, text(rng.randint(10, 70))) for i in range(40)]
    rows, want = [], set()
    for i in range(400):
        own = text(rng.randint(0, 250))
        if i % 10 == 0:
            item_id, item = rng.choice(items)
            copy = [w if rng.random() > 0.1 else rng.choice(vocabulary) for w in item]
            at = rng.randint(0, len(own))
            own = own[:at] + copy + own[at:]
            if lcs(item, copy) >= 0.7 * len(item):
                want.add((i, item_id))
        rows.append((i, " ".join(own)))
    bench = [(i, " ".join(w)) for i, w in items] + [(90, "too short"), (91, None), (None, "no id at all in this item, really")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    given = docs(spark, [*rows, *AWKWARD])
    models = decontamination.fit_leaks(given, bench)
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(given, models).collect()}
    assert want <= found and {d for d, _ in found} <= {i for i in range(0, 400, 10)}
    assert decontamination.contaminated(docs(spark, []), models).collect() == []
    none = decontamination.fit_leaks(given, bench.limit(0))
    assert decontamination.contaminated(given, none).collect() == []
    assert decontamination.without_leaks(given, none).count() == given.count()


def test_latent_space_is_of_all_passages(spark, monkeypatch):
    """Every text takes part in the fit, and the products of terms are those of all passages."""
    rng = random.Random(17)
    vocabulary = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(3000)]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(20)]
    given, seen = docs(spark, rows), []
    whole = decontamination.latent_space

    def watched(texts, benchmark, lookup, idf):
        seen.append(texts.count())
        products, number = decontamination.passage_products(texts, lookup, idf)
        row, term, value, n = decontamination._sparse_passages(decontamination.Words(pa.array([t for _, t in rows])), lookup, idf)
        dense = np.zeros((n, len(idf)))
        dense[row, term] = value
        got = np.zeros((len(idf), len(idf)))
        for r in products.collect():
            got[r["one"], r["other"]] = got[r["other"], r["one"]] = r["product"]
        assert number == n and np.allclose(got, dense.T @ dense)
        space = whole(texts, benchmark, lookup, idf)
        own = decontamination._sparse_passages(decontamination.Words(benchmark), lookup, idf)
        sides = np.zeros((own[3], len(idf)))
        sides[own[0], own[1]] = own[2]
        both = dense.T @ dense + sides.T @ sides * max(1.0, n / own[3])
        best = np.sort(np.linalg.eigvalsh(both))[::-1][: space.shape[1]].sum()
        assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-4)
        assert np.trace(space.T @ both @ space) >= 0.98 * best
        return space

    monkeypatch.setattr(decontamination, "latent_space", watched)
    monkeypatch.setattr(decontamination, "HELD_PRODUCTS", 5000)
    decontamination.fit_leaks(given, spark.createDataFrame(bench, "item_id long, text string"))
    assert seen == [len(rows)]


def test_leak_search_keeps_every_window():
    """Latent candidates against a brute-force search of the same passages."""
    rng = random.Random(9)
    words = [f"r{i}" for i in range(500)]
    item = [rng.choice(words) for _ in range(30)]
    texts = [" ".join([*[f"x{j}" for j in range(shift)], *item, "tail"]) for shift in range(40)]
    column = pa.array([" ".join(item)])
    items = decontamination._read_items(column, [1])
    keys = np.unique(np.array(items[0].words, np.uint64))
    lookup, idf = toxicity.Lookup(keys), np.ones(len(keys))
    space = np.eye(len(keys))
    parsed = decontamination.Words(column)
    at, place = lookup.found(parsed.hashes)
    block, first = decontamination._stretches(parsed, at)
    latent = decontamination._latent(np.array([0]), block, place, first, space.astype(np.float32))
    model = decontamination.LeakModel(keys, idf, space.astype(np.float32), latent, np.array([0]), items)
    assert all(f and f[0]["share"] == 1.0 for f in decontamination._found_in(model)(pa.array(texts)))


def leak_pairs(spark, rows, bench):
    given = docs(spark, rows)
    models = decontamination.fit_leaks(given, spark.createDataFrame(bench, "item_id long, text string"))
    kept = {r.doc_id for r in decontamination.without_leaks(given, models).collect()}
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(given, models).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in found}
    return found


@pytest.mark.parametrize("edits", [0, 0.1, 0.3])
def test_items_leaked_into_half_of_the_texts_are_found(spark, edits):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]

    def text(n):
        return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]

    items = {i: text(40) for i in range(20)}
    rows, want = [], set()
    for i in range(300):
        own = text(rng.randint(20, 120))
        if i % 2:
            copy = [w if rng.random() >= edits else rng.choice(vocabulary) for w in items[0]]
            at = rng.randint(0, len(own))
            own = own[:at] + copy + own[at:]
            if lcs(items[0], copy) >= 0.6 * len(copy):
                want.add((i, 0))
        rows.append((i, " ".join(own)))
    found = leak_pairs(spark, rows, [(i, " ".join(w)) for i, w in items.items()])
    assert want <= found and {d % 2 for d, _ in found} == {1} and {i for _, i in found} == {0}


@pytest.mark.parametrize("size", [1, 5, 10])
def test_a_leak_in_a_small_table_is_found(spark, size):
    rng = random.Random(size)
    item = [f"q{i}" for i in range(20)]
    rows = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(50))) for i in range(size)]
    rows[0] = (0, rows[0][1] + " " + " ".join(item))
    assert leak_pairs(spark, rows, [(5, " ".join(item))]) == {(0, 5)}


def test_items_of_common_words_are_found_without_a_quote(spark):
    rng = random.Random(12)
    common = [f"c{i}" for i in range(60)]
    item = [rng.choice(common) for _ in range(30)]
    # Every fourth word is another one, so no four words in a row stay.
    copy = [w if i % 4 else "other" for i, w in enumerate(item)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(60))) for i in range(60)]
    rows[7] = (7, " ".join(copy))
    found = leak_pairs(spark, rows, [(1, " ".join(item))])
    assert (7, 1) in found


def test_recall_of_a_full_block(spark):
    """The real fit on 1000 items against the common subsequences of planted edits."""
    rng = random.Random(17)
    vocabulary = [f"v{i}" for i in range(8000)]
    weights = [1 / (i + 3) for i in range(len(vocabulary))]

    def text(n):
        return rng.choices(vocabulary, weights, k=n)

    items = [text(rng.randint(20, 60)) for _ in range(decontamination.BLOCK_ITEMS)]
    rows, want = [], set()
    for i in range(1200):
        number, own = rng.randrange(len(items)), text(rng.randint(50, 150))
        copy = [w if rng.random() > 0.3 else text(1)[0] for w in items[number]]
        rows.append((i, " ".join(own[:40] + copy + own[40:])))
        if lcs(items[number], copy) >= decontamination.COMMON * len(copy):
            want.add((i, number))
    given = docs(spark, rows)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    models = decontamination.fit_leaks(given, bench)
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(given, models).collect()}
    print("recall", len(want & found), len(want), "others", len(found - want))
    assert len(models) == 1 and len(want & found) >= 0.9 * len(want)


def test_samples_do_not_vanish_in_large_tables(spark):
    rows = spark.range(4_000_000).select(F.xxhash64("id").alias("mark"))
    for wanted, total in ((5, 10_000_000), (600, 10**9), (10**6, 10**12), (4_000_000, 10**7), (7, 3)):
        share = min(1.0, wanted / total)
        found = rows.filter(taken(F.col("mark"), wanted, total)).count()
        assert abs(found - share * 4_000_000) <= 6 * (share * 4_000_000) ** 0.5 + 4
    # One row in 50 million: none here, but the condition can be met.
    assert spark.range(1).select(taken(F.lit(0).cast("long"), 1, 1)).first()[0]


def test_a_repeated_row_is_one_row_of_a_labelled_sample(spark):
    text = "some words of a row that stands very often"
    rows = [(1, text)] * 10_000 + [(2, text), (3, "another"), (3, "text"), (4, "no label"), (None, "no id")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (3, 0), (None, 1), (5, 1), (4, None)], "doc_id long, quality int")
    found = labelled_sample(docs(spark, rows), labels, "quality")
    assert sorted(tuple(r) for r in found.collect()) == [(1, text, 1), (3, "another", 0), (3, "text", 0)]


def test_short_items_are_found_word_for_word(spark):
    benchmark = spark.createDataFrame(
        [(1, "What is the capital?"), (2, "Yes."), (3, "one two three four five six seven"), (4, "one two three four"), (5, None)],
        "item_id long, text string",
    )
    rows = [(1, "so what IS the capital? I asked, what is the capital?"), (2, "what is a capital?"), (3, "yes."), (4, None)]
    rows += [(5, "zero one two three four five six seven"), (6, "one two three 4")]
    models = decontamination.fit_leaks(docs(spark, rows), benchmark)
    found = {(r.doc_id, r.item_id, r.first_word) for r in decontamination.contaminated(docs(spark, rows), models).collect()}
    assert found == {(1, 1, 1), (5, 3, 1), (5, 4, 1)}
