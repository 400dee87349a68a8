"""Operator 11 against a plain search for runs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.conftest import DATA
from zonepack.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, runs string, best long, words int"
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(doc_id, word):
    h, n = zlib.crc32(str(doc_id).encode()), len(word)
    if doc_id is None or h % 10 or not n:
        return word
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else word[a + (i - a) % p] for i, w in enumerate(word)]


def plain_runs(word, least=6):
    """All maximal stretches by every period; the smallest period of a stretch is the first that it is found with."""
    found, seen = [], set()
    for q in range(1, len(word) // 4 + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j + q - i >= max(least, 4 * q) and j > i and (i, j + q) not in seen:
                seen.add((i, j + q))
                found.append((i, j + q - i, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    word = planted(doc_id, words(text))
    runs = plain_runs(word)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(listed), digest(" ".join(w for i, w in enumerate(word) if i not in gone)))


def coded(text):
    return np.unique(list(text), return_inverse=True)[1].astype(np.int64) if text else np.zeros(0, dtype=np.int64)


@pytest.mark.parametrize("rounds", [0, 1, 64])
def test_random_words(rounds, monkeypatch):
    pick = random.Random(rounds)
    texts = ["".join(pick.choice("abc"[: pick.randint(1, 3)]) for _ in range(pick.randint(0, 60))) for _ in range(150)]
    for _ in range(150):  # powers of short words between others, some inside each other
        inner = "".join(pick.choice("ab") for _ in range(pick.randint(1, 3))) * pick.randint(1, 7)
        texts.append("".join([pick.choice(["", "xyz", inner]), (inner + pick.choice(["", "c"])) * pick.randint(1, 6), inner[:2], pick.choice(["", "uvw"])]))
    texts += ["", "a", "a" * 500, "ab" * 300, "aaaaab" * 40, "abcdefg" * 4 + "abc", "a" * 5, "a" * 6, "ab" * 3 + "a", "ab" * 4, "abaab" * 30]
    monkeypatch.setattr(P.segments, "__defaults__", (rounds,))
    _, at = np.unique([c for t in texts for c in t], return_inverse=True)
    found = P.runs_of(at.astype(np.int64), np.cumsum([len(t) for t in texts]))
    for text, own in zip(texts, found):
        assert own == plain_runs(text), text


def test_splitting_spares_what_cannot_repeat():
    text = "u v w".split() + "a b a b a b a b".split() + "a x c a y".split() + "d d d d d d".split()
    numbers = np.unique(text, return_inverse=True)[1].astype(np.int64)
    assert P.segments(numbers, np.array([len(text)])) == [(3, 12), (16, 22)]
    assert P.runs_of(numbers, np.array([len(text)])) == [[(3, 9, 2), (16, 6, 1)]]


def test_long_texts():
    """Many lags with equal blocks, and a long period."""
    assert P.lag_scan(np.zeros(200_000, dtype=np.int64)) == [(0, 200_000, 1)]
    assert P.lag_scan(np.tile(np.arange(9_000), 5)[: 4 * 9_000 + 7]) == [(0, 36_007, 9_000)]
    a, b = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)
    for _ in range(13):  # overlap-free: nothing repeats three times, and block hashes modulo 2^64 collide
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    assert P.lag_scan(a) == []


def test_odd_tables(spark):
    texts = ["", None, " \n\t", "a " * 40, "x" * 30_000, "a\x1cb " * 8, "la la la la la la", "la la la la la", "　漢 " * 9, " ".join("ab" * 4), "é é " * 7]
    rows = [(i, t, "r", 1, 2) for i, t in enumerate(texts)] + [(None, "go " * 9, "r", 1, 2), (3, "a " * 40, "r", 1, 2), (3, "b " * 6, "r", 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(P.periodic_runs(docs).select("doc_id", "n_words", "runs", "best", "collapsed").collect(), key=str)
    for r in found:
        fits = [plain_runs(words(t)) for d, t, *_ in rows if d == r.doc_id]
        assert [(x.start, x.length, x.period) for x in r.runs] in fits
        assert (r.best is None) == (not r.runs)
    assert len(found) == len(rows) and P.periodic_runs(docs.limit(0)).collect() == []
    assert {r.doc_id: r.collapsed for r in found if r.doc_id in (1, 3, 6, 7)} | {3: "a"} == {1: "", 3: "a", 6: "la", 7: "la la la la la"}


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = P.op11_periodic_runs(spark, DATA).select(COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(expected(r.doc_id, r.text) for r in rows)
    assert sum(r.n_runs > 0 for r in found) > 5
