"""Operator 10, quality classifier: a generalised additive model with pairwise interactions.

Features are counts over the whole text (byte classes, words, repeats, lines), each cut into at most
``BINS`` quantile bins. Boosting goes round the features: a shallow tree over one feature's bins is
fitted to the logistic gradient and added, shrunk, to that feature's table. Then the ``PAIRS``
feature pairs whose 2-d cells explain most of what is left are boosted in the same cyclic way. A
score is the intercept plus one table entry for each feature and pair, through the logistic
function; it is computed for whole batches by indexed additions.

Features of all rows are made in one pass and staged (about 150 bytes a row); learning joins them
with the labels of rows whose crc32(doc_id as text) mod 5 is not 0 and takes at most about ``SAMPLE``
of these, chosen by a hash of doc_id. The driver gets this bounded sample of features and no text.

Null and empty texts have all features 0 and are scored like others. Null quality and labels of
absent documents are left out; repeated label rows weigh as often as they occur. Without usable
labels, or with one class only, the score is the share of label 1 (0.5 if there is none). Repeated
rows and null ids: one row each. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.shared import documents, held_out, sample_filter, slices, stage
from zonepack.llm.word_ids import take_turn

SAMPLE = 20_000
BINS = 32
ROUNDS = 120
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
LEAVES = 4
THRESHOLD = 0.3

FEATURES = [
    "log_bytes", "upper", "digit", "space", "stop", "symbol", "high", "newline", "log_words", "word_bytes",
    "distinct_words", "top_word", "same_as_before", "odd_end", "short_words", "long_words", "log_lines", "distinct_lines", "words_in_line",
]

#: Byte classes: lower, upper, digit, space, end of sentence and comma, other symbols, part of a longer character, line feed.
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[[9, 11, 12, 13, 32]], _CLASS[[44, 46]], _CLASS[10] = 3, 4, 7
_ODD = frozenset("#$%&*|!<>{}=~^_@+\\/")


def features(texts: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` for every text."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    kind = _CLASS[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw)) * 8, sizes)
    share = np.bincount(owner + kind, minlength=len(raw) * 8).reshape(-1, 8) / np.maximum(sizes, 1)[:, None]
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0] = np.log1p(sizes)
    out[:, 1:8] = share[:, 1:]
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        n = len(words)
        found = Counter(words)
        lines = text.split("\n")
        lengths = list(map(len, words))
        out[i, 8:] = (
            np.log1p(n), sum(lengths) / n, len(found) / n, max(found.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, sum([w[-1] in _ODD for w in words]) / n,
            sum([k < 4 for k in lengths]) / n, sum([k > 12 for k in lengths]) / n, np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines),
        )
    return out


def _tree(gradient: np.ndarray, curvature: np.ndarray, leaves: int) -> np.ndarray:
    """Values of a tree of ``leaves`` leaves at most over ordered bins: the best split first."""
    spans, value = [(0, len(gradient))], np.zeros(len(gradient))
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(curvature)])
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(spans) < leaves:
        best = (1e-9, None, None)
        for a, b in spans:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = score(a, cut) + score(cut, b) - score(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), (a, b), int(cut[gain.argmax()]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in spans:
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return value


def _pair_tree(gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The same over a grid: one axis is cut once, each side then along the other axis; the better axis first."""
    best = None
    for swap in (False, True):
        g, h = (gradient.T, curvature.T) if swap else (gradient, curvature)
        rows = _tree(g.sum(axis=1), h.sum(axis=1), 2)
        value, gain = np.zeros_like(g), 0.0
        for side in np.unique(rows):
            part = rows == side
            cells = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 2)
            value[part] = cells
            gain += float((g[part] * cells).sum())
        if best is None or gain > best[0]:
            best = (gain, value.T if swap else value)
    return best[1]


class AdditiveModel:
    """Tables of each feature's bins and of chosen pairs' cells; scored by additions."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rate = float(np.mean(y)) if len(y) else 0.5
        self.pairs: list[tuple[int, int]] = []
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.empty(0) for f in range(len(FEATURES))]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables: list[np.ndarray] = []
        self.constant = rate if rate in (0.0, 1.0) or not len(y) else None
        self.intercept = 0.0 if self.constant is not None else float(np.log(rate / (1 - rate)))
        if self.constant is not None:
            return
        bins = self.bins(x)
        logit = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-logit))
                step = RATE * _tree(np.bincount(bins[f], y - p, len(table)), np.bincount(bins[f], p * (1 - p), len(table)), LEAVES)
                table += step
                logit += step[bins[f]]
        p = 1 / (1 + np.exp(-logit))
        gains = []
        for a in range(len(FEATURES)):
            for b in range(a + 1, len(FEATURES)):
                g, h = self._cells(bins, a, b, y - p), self._cells(bins, a, b, p * (1 - p))
                gains.append((float((g * _pair_tree(g, h)).sum()), -a, -b))
        self.pairs = [(-a, -b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.tables[a]), len(self.tables[b]))) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in zip(self.pairs, self.pair_tables):
                p = 1 / (1 + np.exp(-logit))
                step = RATE * _pair_tree(self._cells(bins, a, b, y - p), self._cells(bins, a, b, p * (1 - p)))
                table += step
                logit += step[bins[a], bins[b]]

    def _cells(self, bins: list[np.ndarray], a: int, b: int, weight: np.ndarray) -> np.ndarray:
        shape = len(self.tables[a]), len(self.tables[b])
        return np.bincount(bins[a] * shape[1] + bins[b], weight, shape[0] * shape[1]).reshape(shape)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        bins = self.bins(x)
        logit = np.full(len(x), self.intercept)
        for b, table in zip(bins, self.tables):
            logit += table[b]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            logit += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-logit))


def featurise(docs: DataFrame) -> DataFrame:
    """(doc_id, one double column for each of ``FEATURES``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("features")
        for rows, texts in slices(batches):
            x = features(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x[:, f]) for f in range(len(FEATURES)))], ["doc_id", *FEATURES])

    return documents(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{f} double" for f in FEATURES)]))


def labelled(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` of the labelled rows (doc_id, features, quality) to learn from, the same ones on each run. They are chosen row
    by row, so an id that a third of all rows have fills no more of them than its share; rows that are the same count once."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out())
    known = rows.join(usable, "doc_id").distinct()
    return known.where(sample_filter(known.count(), sample, "doc_id", "quality", *FEATURES))


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """``rows`` as ``featurise`` returns them, ``labels`` with doc_id and quality (0 or 1)."""
    joined = labelled(rows, labels, sample).toPandas().sort_values(["doc_id", *FEATURES, "quality"], kind="stable")
    return AdditiveModel(joined[FEATURES].to_numpy(np.float64), joined["quality"].to_numpy(np.float64))


def classify(rows: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows that ``featurise`` has made."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(np.column_stack([batch.column(f).to_numpy() for f in FEATURES]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(featurise(spark.read.parquet(f"{sf_dir}/documents.parquet")), "features")
    return classify(rows, fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
