"""Operator 13 against exact sets, and its sketches against exact similarities."""

import random
import re

import numpy as np
import pytest

from tests.conftest import DATA
from zonepack.llm import odd_sketch as O

SCHEMA = "doc_id long, text string, keys string, n string, label long"


def shingles(text, width=3):
    word = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(word[i : i + width]) for i in range(len(word) - width + 1)} if len(word) >= width else {tuple(word)} if word else set()


def expected(rows, percent=85, width=3):
    """{doc_id: smallest reachable doc_id} by all pairs."""
    sets = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = sorted((root(a), root(b)))
                parent[b2] = a2
    return {d: root(d) for d in parent}


def families(seed, count=12, size=9):
    """Texts with copies that differ from them, and from each other, by a little or too much; templated pages that never link."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randint(0, 5000)}"
    texts = []
    for _ in range(count):
        base = [word() for _ in range(pick.randint(1, 150))]
        texts.append(base)
        for _ in range(pick.randint(0, size)):
            copy = list(base)
            for _ in range(pick.randint(0, 1 + len(copy) // 30)):
                copy[pick.randrange(len(copy))] = word()
            texts.append(copy)
    page = [word() for _ in range(120)]
    texts += [page + [word() for _ in range(40)] for _ in range(30)]
    texts = [" ".join(t) for t in texts] + ["", None, " \n", "one", "ONE", "one two", "One  two", texts and " ".join(page)]
    pick.shuffle(texts)
    return list(enumerate(texts, 100))


def test_bounds_of_sketches_and_bands():
    pick = np.random.default_rng(1)
    limit, bands = O.most_apart(85, O.SAMPLES), O.bands_for(85)
    assert (1 - 0.85**O.ROWS) ** bands <= O.MISSED and bands * O.ROWS <= O.SAMPLES and 2 * O.SAMPLES * 0.15 < limit < O.SKETCH_BITS / 4
    for share in (0.0, 0.5, 0.7, 0.85, 0.9, 0.99):
        found = []
        for _ in range(40):
            tokens = pick.integers(0, 1 << 64, 2000, dtype=np.uint64)
            both = int(2000 * share)
            a, b = (np.unique(np.concatenate([tokens[:both], pick.integers(0, 1 << 64, (2000 - both + 1) // 2, dtype=np.uint64)])) for _ in range(2))
            values = O.minhashes([a, b], O.SAMPLES)
            x, y = O.odd_sketches(values)
            apart = int(np.bitwise_count(x ^ y).sum())
            assert apart <= 2 * (values[0] != values[1]).sum()
            keys = O.band_keys(values, bands)
            if share >= 0.85:
                assert apart <= limit and (keys[0] == keys[1]).any()
            found.append(O.estimate(apart))
        if share >= 0.5:
            assert abs(np.mean(found) - share) < 0.02 and np.std(found) < 0.06
        else:
            assert np.mean(found) < 0.2


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [512, 3])
def test_components_equal_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(O, "BLOCK", block)
    rows = families(seed)
    for percent, width in ((85, 3), (80, 5)):
        found = O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent, width).collect()
        assert {r.doc_id: r.component_id for r in found} == expected(rows, percent, width)
        assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id], width)) for r in found)


def test_chains_without_a_centre(spark):
    """Each text links with the next only: no pivot reaches far, blocks find the rest."""
    pick = random.Random(4)
    texts = [[f"w{pick.randint(0, 9999)}" for _ in range(200)]]
    for i in range(40):
        texts.append([*texts[-1][4:], *[f"v{i}{k}" for k in range(4)]])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = O.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert {r.component_id for r in found.collect()} == {0} == set(expected(rows).values())


def test_odd_tables(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b c d"), (9, "A b c d"), (None, "a b c d"), (None, None), (3, "a b c d"), (5, "p q r s"), (5, "k l m n"), (6, "k l m n"), (4, "P q r s"), (7, long), (8, long + " end")]
    docs = spark.createDataFrame([(*r, "k", "n", 1) for r in rows], SCHEMA).repartition(2)
    found = sorted(map(tuple, O.near_duplicates(docs).collect()), key=str)
    wanted = [(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (3, 2, 3, True), (9, 2, 3, False), (5, 2, 4, False), (5, 2, 4, False), (6, 2, 4, False), (4, 2, 4, True), (7, 29_998, 7, True), (8, 29_999, 7, False), (None, 2, None, True), (None, 0, None, True)]
    assert found == sorted(wanted, key=str)
    assert O.near_duplicates(docs.limit(0)).collect() == []


def test_query(spark, rows, sql_rows):
    df = O.op13_minhash(spark, DATA)
    columns, wanted = sql_rows(O.OP13_SQL)
    assert sorted(df.columns) == columns and rows(df) == wanted
