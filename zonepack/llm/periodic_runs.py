"""Operator 11, periodic runs of words: recursive frequency splitting, then a lag scan.

Words are runs of bytes other than ASCII white space. A run is a stretch of consecutive words with smallest
period q (words q apart are identical) of at least max(``LEAST``, ``REPEATS`` * q) words, which no neighbouring word
extends keeping period q. Each of its words occurs at least ``REPEATS`` times in it. So:

1. Splitting. A word that occurs fewer than ``REPEATS`` times in its segment is in no run, and no run goes across it: it
   splits the segment. Counts are taken anew in what is left, again and again, until no segment changes; those of
   fewer than ``LEAST`` words go. All texts of a batch are split together, and only segments that have changed
   are counted again. What still changes after ``ROUNDS`` rounds (words may be built so that each round takes one
   off) goes on as it is: splitting only spares work, the scan finds the same runs without it.
2. Lag scan of each segment that is left. A run of period q has at least 4 q words, so that three equal blocks of q words
   begin at one of its positions that are multiples of q. For each lag the hashes of the blocks at these
   positions are compared, m / q of them in a segment of m words, m log m in all. Different hashes are
   different blocks, so no run is lost; a lag whose blocks agree anywhere outside the known runs of its divisors
   (whose multiples they are) is compared word by word through the segment. Words are compared as numbers
   that the batch's dictionary gives them: the runs are exact.

The work is one map; a text lies in one task with its own words only, whatever its length. Words of runs after the first
period are what ``collapsed`` leaves out.

Null, empty and blank texts have no words and no runs; their collapsed text is empty. Repeated rows and null ids: a
row each, as they come. Ties of the greatest exponent go to the smallest start, then period. Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.shared import cuts, documents
from zonepack.llm.word_ids import strings, take_turn, words_of

LEAST, REPEATS, ROUNDS = 6, 4, 64
_ODD = 0x9E3779B97F4A7C15

Runs = list[tuple[int, int, int]]


def segments(words: np.ndarray, ends: np.ndarray, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """[begin, end) of what frequency splitting leaves of texts, whose words (numbers) lie one after the other and end at ``ends``."""
    at = np.arange(len(words))
    segment = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    done: list[tuple[int, int]] = []
    for _ in range(rounds):
        if not len(at):
            break
        keys = segment * np.int64(int(words.max()) + 1) + words[at]
        _, own, counts = np.unique(keys, return_inverse=True, return_counts=True)
        keep = counts[own] >= REPEATS
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        stable = np.logical_and.reduceat(keep, starts)
        sizes = np.diff(np.append(starts, len(at)))
        done += [(int(at[s]), int(at[s] + n)) for s, n in zip(starts[stable].tolist(), sizes[stable].tolist()) if n >= LEAST]
        keep &= ~np.repeat(stable, sizes)
        at, segment = at[keep], segment[keep]
        breaks = (np.diff(at, prepend=-2) != 1) | (np.diff(segment, prepend=-1) != 0)
        segment = np.cumsum(breaks) - 1
        large = (np.bincount(segment) >= LEAST)[segment] if len(at) else np.zeros(0, dtype=bool)
        at, segment = at[large], segment[large]
    else:
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        done += [(int(at[s]), int(at[s] + n)) for s, n in zip(starts.tolist(), np.diff(np.append(starts, len(at))).tolist())]
    return sorted(done)


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as they have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            factors = [np.full(size, f, dtype=np.uint64) for f in (_ODD, pow(_ODD, -1, 1 << 64))]
            for f in factors:
                f[0] = 1
            self.up, self.down = map(np.cumprod, factors)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def lag_scan(words: np.ndarray) -> Runs:
    """(start, length, period) of the runs of a segment, by period."""
    m = len(words)
    up, down = _powers.to(m + 1)
    sums = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[:m], out=sums[1:])
    found: Runs = []
    periods: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in range(1, m // REPEATS + 1):
        edges = sums[::q]
        blocks = (edges[1:] - edges[:-1]) * down[: m : q][: len(edges) - 1]
        same = blocks[1:] == blocks[:-1]
        cubes = np.flatnonzero(same[1:] & same[:-1]) * q
        for p, (starts, ends) in periods.items() if len(cubes) else ():
            if q % p == 0:  # inside a run of a divisor: the same run once more
                own = np.searchsorted(starts, cubes, "right") - 1
                cubes = cubes[(own < 0) | (ends[own] < cubes + 3 * q)]
        if not len(cubes):
            continue
        equal = np.concatenate([[False], words[q:] == words[:-q], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        starts, ends = edges[::2], edges[1::2] + q
        fits = ends - starts >= max(LEAST, REPEATS * q)
        starts, ends = starts[fits], ends[fits]
        for p, (first, last) in periods.items():
            if q % p == 0 and len(starts):
                own = np.searchsorted(first, starts, "right") - 1
                new = (own < 0) | (last[own] < ends)
                starts, ends = starts[new], ends[new]
        if len(starts):
            periods[q] = starts, ends
            found += [(s, e - s, q) for s, e in zip(starts.tolist(), ends.tolist())]
    return found


def runs_of(words: np.ndarray, ends: np.ndarray) -> list[Runs]:
    """For each text its runs, by start, then period."""
    found: list[Runs] = [[] for _ in ends]
    begins = np.concatenate([[0], ends[:-1]])
    for begin, end in segments(words, ends):
        text = int(np.searchsorted(ends, begin, "right"))
        found[text] += [(s + begin - int(begins[text]), n, q) for s, n, q in lag_scan(words[begin:end])]
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(n: int, runs: Runs) -> np.ndarray | None:
    """Which of ``n`` words are in no run after its first period; None if all are."""
    if not runs:
        return None
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row. ``runs`` is an array of (start, length, period) by start,
    then period, ``best`` the place in it of the run with the greatest length by period (null: no run), ``collapsed``
    the words that are in no run after its first period, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("runs")
        for rows in cuts(batches):
            words, index, ends = words_of(rows.column("text"))
            spelled = np.array(strings(words), dtype=object)
            best, collapsed, begin = [], [], 0
            found = runs_of(index, ends)
            for end, own in zip(ends.tolist(), found):
                kept = kept_words(end - begin, own)
                text = index[begin:end] if kept is None else index[begin:end][kept]
                collapsed.append(" ".join(spelled[text].tolist()))
                best.append(min(range(len(own)), key=lambda i: (-Fraction(own[i][1], own[i][2]), own[i][0], own[i][2])) if own else None)
                begin = end
            named = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
            sizes = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(named, _RUNS), pa.array(best, pa.int32()), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "best", "collapsed"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, best int, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which, by the checksum h of doc_id, one text in ten ends in repeats of a stretch of its own:
    with g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), word i >= a becomes word a + (i - a) % p. The
    others, and those with a null id, stay as they are."""

    def repeated(doc_id: int, text: str) -> str:
        word = text.encode().split()  # of bytes: the ASCII white space only
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(word)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(word[:a] + [word[a + (i - a) % p] for i in range(a, n)]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cuts(batches):
            texts = rows.column("text")
            ids = rows.column("doc_id").to_pylist()
            chosen = [i for i, d in enumerate(ids) if d is not None and zlib.crc32(str(d).encode()) % 10 == 0]
            new = {i: repeated(ids[i], t) for i in chosen if (t := texts[i].as_py()) is not None and t.encode().split()}
            if new:
                mask = np.zeros(len(ids), dtype=bool)
                mask[list(new)] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], pa.string()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), texts], ["doc_id", "text"])

    return documents(docs).mapInArrow(run, "doc_id long, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.try_element_at("runs", F.col("best") + 1)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * try_element_at(runs, best + 1).length div try_element_at(runs, best + 1).period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
