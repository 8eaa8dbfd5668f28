"""Near duplicates, components and sketches against brute force."""

import itertools
import random

import numpy as np
import pytest
from helpers_llm import AWKWARD, docs, words

from fieldloom.llm.components import components
from fieldloom.llm.near_duplicates import COORDINATES, EMPTY, band_rows, near_duplicates, sketch


def brute(rows, percent):
    sets = []
    for doc_id, text in rows:
        w = words(text)
        sets.append((doc_id, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (d, s), (e, t) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(s & t) >= percent * len(s | t):
            parent[max(root(d), root(e))] = min(root(d), root(e))
    return sorted(
        ((d, len(s), None if d is None else root(d), d is None or root(d) == d) for d, s in sets), key=repr
    )


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_brute_force(spark, percent):
    """One large group of edited copies, chains of edits, exact copies, and strangers."""
    rng = random.Random(percent)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(150, 170):
        chain = [*chain[2:], f"c{i}", f"d{i}"]
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(170, 200)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]
    got = sorted((tuple(r) for r in near_duplicates(docs(spark, rows), percent).collect()), key=repr)
    assert got == brute(rows, percent)


def test_awkward_rows(spark):
    got = sorted((tuple(r) for r in near_duplicates(docs(spark, AWKWARD)).collect()), key=repr)
    assert got == brute(AWKWARD, 80)


def test_empty_table(spark):
    df = near_duplicates(docs(spark, []))
    assert df.collect() == [] and df.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 100), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    shared, own, other = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    values = sketch([np.concatenate([shared, own]), np.concatenate([shared, other]), own[:1], own[:0]])
    assert (values[:3] != EMPTY).all() and (values[3] == EMPTY).all()
    assert abs((values[0] == values[1]).mean() - 0.8) < 0.12
    assert (1 - 0.85 ** band_rows(85)) ** (COORDINATES // band_rows(85)) <= 1e-4


def test_repeated_rows_and_ids_equal_brute_force(spark):
    """Rows repeated 1 to 50 times in one large bucket, and ids that stand over two texts."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        rows += [(i, " ".join(copy))] * rng.choice([1, 1, 2, 50])
    strangers = [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(8)]
    rows += [(100 + i, t) for i, t in enumerate(strangers)] + [(100, strangers[1]), (3, strangers[5]), (105, strangers[5])]
    got = sorted((tuple(r) for r in near_duplicates(docs(spark, rows), 85).collect()), key=repr)
    assert got == brute(rows, 85)


def test_links_are_confirmed_once_for_repeated_rows(spark, monkeypatch):
    from fieldloom.llm import near_duplicates as module

    sizes = {}
    write = module.written
    monkeypatch.setattr(module, "written", lambda df, name: sizes.setdefault(name, write(df, name)))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 50 + [(2, text + " end")] * 50
    near_duplicates(docs(spark, rows), 80).collect()
    assert sizes["sets"].count() == 2 and sizes["links"].count() == 1
