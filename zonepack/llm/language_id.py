"""Operator 1, language identification: prediction by partial matching over bytes.

Each learned language has a context tree: for contexts of up to ``ORDER`` bytes, how often each
byte followed. A byte's probability in a context with n sightings of d distinct bytes is
count / (n + d); a byte unseen there pays the escape d / (n + d) and is coded in the next shorter
context, down to a uniform code over the alphabet. The counts are frozen after learning, so the code
length of a text is exact and does not depend on what was read before it; the language with the
shortest one is predicted, ``score`` is its share of the probability under equal priors.

Because the counts are frozen, all escapes are resolved once: every context that the trees keep is a
row of code lengths for each next byte and language. The trees are pruned to the ``MOST_CONTEXTS`` most
frequent contexts; others fall back to their longest kept suffix, so their order varies. Byte values
beyond the ``MOST_SYMBOLS`` most frequent are one symbol; each of them pays for the choice among these,
so lengths are those of a code that can be decoded, on any corpus. Scoring is two table look-ups a
byte, in numpy over whole texts.

``score`` is the share of the predicted language in the probability that the trees give to a stretch of
``STRETCH`` bytes at the text's own rate (to the whole text if it is shorter): over a whole long text
the share would be 1 for any language that is a little ahead.

Learning reads text and non-null lang of rows whose crc32(doc_id as text) mod 5 is not 0: at most
about ``SAMPLE`` rows of a language, chosen by a hash of doc_id, and all rows below that. Spark
counts the byte runs; the driver gets at most the distinct ones of the sample.

``und``, score 0: text is null or has no letter, or nothing could be learned (an empty table). Very
long texts are scored whole, in slices of bounded size. Ties go to the language first by name.
Repeated rows and null ids: one row each. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.shared import documents, held_out, sample_filter, slices
from zonepack.llm.word_ids import take_turn

ORDER = 3
SAMPLE = 1000
MOST_CONTEXTS = 8192
MOST_SYMBOLS = 160
LETTER = re.compile(r"[^\W\d_]")
STRETCH = 64
#: A text is in none of the learned languages when even the best code of its words is longer, by more than
#: ``MARGIN_BITS``, than ``REJECT_BITS`` a byte, which is half as much again as plain bytes. Held-out texts of the
#: learned languages take 2 to 4 bits a byte (up to 10 in rare capitals, when few texts were learned), others from 14 up.
REJECT_BITS = 12.0
MARGIN_BITS = 64.0
#: Runs between white space that hold one of these bytes are numbers, keys, addresses or markup, no words.
_ODD = np.isin(np.arange(256), np.frombuffer(b"0123456789@/_=\\<>{}", dtype=np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))


def _runs(raw: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number; zero bytes stand before the beginning."""
    b = np.frombuffer(bytes(ORDER) + raw, dtype=np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


class Trees:
    """The context trees of all languages as one table: row of a context x symbol x language -> bits."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        seen = np.bincount(np.concatenate([r & 0xFF for r, _ in counts]).astype(np.int64), np.concatenate([n for _, n in counts]).astype(np.float64), 256)
        seen[0] = 0
        frequent = np.argsort(-seen, kind="stable")[:MOST_SYMBOLS]
        frequent = np.sort(frequent[seen[frequent] > 0])
        self.symbol = np.zeros(256, dtype=np.int64)  # 0: any other byte, and what is before the beginning
        self.symbol[frequent] = np.arange(1, len(frequent) + 1)
        self.size = size = len(frequent) + 1
        runs = [self._symbols(r) for r, _ in counts]
        contexts, weights = np.unique(np.concatenate([r[:, 0] * size**2 + r[:, 1] * size + r[:, 2] for r in runs]), return_inverse=True)
        weights = np.bincount(weights, np.concatenate([n for _, n in counts]))
        keep = np.sort(np.argsort(-weights, kind="stable")[:MOST_CONTEXTS])
        kept = [np.zeros(1, dtype=np.int64), np.arange(size), np.unique(contexts[keep] % size**2), contexts[keep]]
        first = np.cumsum([0, *map(len, kept)])
        bits = np.empty((int(first[-1]), size, len(langs)), dtype=np.float32)
        suffix = [None, np.zeros(size, dtype=np.int64), first[1] + kept[2] % size, first[2] + np.searchsorted(kept[2], kept[3] % size**2)]
        for lang, (run, (_, n)) in enumerate(zip(runs, counts)):
            for order, rows in enumerate(kept):
                context = run[:, 3 - order :][:, :order] @ np.array([size**k for k in range(order - 1, -1, -1)], dtype=np.int64) if order else np.zeros(len(run), dtype=np.int64)
                at = np.minimum(np.searchsorted(rows, context), len(rows) - 1)
                found = rows[at] == context
                c = np.bincount(at[found] * size + run[found, 3], n[found], len(rows) * size).reshape(len(rows), size)
                total, distinct = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
                below = bits[suffix[order], :, lang] if order else np.full((1, size), np.log2(size))
                with np.errstate(divide="ignore", invalid="ignore"):
                    here = np.where(c > 0, np.log2(total + distinct) - np.log2(c), np.where(total > 0, np.log2(total + distinct) - np.log2(distinct), 0) + below)
                bits[first[order] : first[order + 1], :, lang] = here
        bits[:, 0] += np.log2(max(1, 256 - len(frequent)))  # a rare byte also says which of the rare ones it is
        self.bits = bits.reshape(-1, len(langs))
        self.row = (first[1] + np.arange(size**3) % size).astype(np.int32)
        pairs = np.full(size**2, -1, dtype=np.int32)
        pairs[kept[2]] = first[2] + np.arange(len(kept[2]))
        deeper = np.tile(pairs, size)
        self.row[deeper >= 0] = deeper[deeper >= 0]
        self.row[kept[3]] = first[3] + np.arange(len(kept[3]))
        self.row *= size

    def _symbols(self, runs: np.ndarray) -> np.ndarray:
        return np.stack([self.symbol[runs >> s & 0xFF] for s in (24, 16, 8, 0)], axis=1)

    def code_lengths(self, texts: list[bytes], words_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every text under every language, and its bytes; of its words alone if ``words_only``."""
        raw = np.frombuffer(b"".join(bytes(ORDER) + t for t in texts), dtype=np.uint8)
        s = self.symbol.astype(np.int32)[raw]
        at = (s[:-3] * self.size + s[1:-2]) * self.size + s[2:-1]
        at = self.row[at] + s[3:]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.cumsum(sizes + ORDER) - sizes - ORDER
        out, counted = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            edges = np.minimum(np.stack([begin[full], begin[full] + sizes[full]], axis=1).ravel(), len(at))
            cost = np.concatenate([self.bits[at], np.zeros((1, len(self.langs)), dtype=np.float32)])
            taken = np.ones(len(cost), dtype=np.int64)
            if words_only:  # the zero bytes between texts end a run as white space does
                run = np.cumsum(_SPACE[raw] | (raw == 0))
                taken[:-1] = (np.bincount(run, _ODD[raw])[run] == 0)[ORDER:]
                cost[taken == 0] = 0
            out[full] = np.add.reduceat(cost, edges, axis=0, dtype=np.float64)[::2]
            counted[full] = np.add.reduceat(taken, edges)[::2]
        return out, counted


def learn(docs: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """The trees of all languages named in the learning rows of ``docs`` (doc_id, text, lang)."""
    rows = documents(docs, "lang").where(F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen |= (F.col("lang") == lang) & sample_filter(n, sample, "doc_id")

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("languages")
        for rows, texts in slices(batches):
            langs = rows.column("lang").to_pylist()
            for lang in set(langs):
                runs, n = np.unique(np.concatenate([_runs(t.encode()) for t, x in zip(texts, langs) if x == lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs), pa.string()), pa.array(runs.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "run", "n"])

    counted = rows.where(chosen).mapInArrow(runs_of, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return None
    langs = sorted(counted["lang"].unique())
    counts = []
    for lang in langs:
        part = counted[counted["lang"] == lang].sort_values("run")
        counts.append((part["run"].to_numpy(np.int64).astype(np.uint32), part["n"].to_numpy(np.float64)))
    return Trees(langs, counts)


def predict(docs: DataFrame, trees: Trees | None, *more: str) -> DataFrame:
    """(doc_id, more..., lang_pred, score, bits_per_byte) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("languages")
        trees = shared.value
        for rows, texts in slices(batches):
            langs, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if LETTER.search(t)] if trees else []
            if some:
                raw = [texts[i].encode() for i in some]
                bits, sizes = trees.code_lengths(raw)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1, keepdims=True)
                ahead = (least - bits) * np.minimum(1, STRETCH / sizes)[:, None]
                score[some] = 1 / np.exp2(np.maximum(ahead, -1000)).sum(axis=1)
                rate[some] = least[:, 0] / sizes
                for i, b in zip(some, best.tolist()):
                    langs[i] = trees.langs[b]
            columns = [c for name, c in zip(rows.schema.names, rows.columns) if name != "text"]
            names = [name for name in rows.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rate)], [*names, "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, bits_per_byte double")


def in_known_language(docs: DataFrame, trees: Trees | None, reject_bits: float = REJECT_BITS, margin: float = MARGIN_BITS) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language; the columns stay. The others go: without a
    letter, or with words (runs without digits and the like) whose best code is longer than ``reject_bits`` a
    byte and ``margin``. One rule for all lengths: the margin leaves texts of a word or two alone, of which
    nothing can be said. With nothing learned all rows go."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("languages")
        trees = shared.value
        for rows, texts in slices(batches):
            keep = np.zeros(len(texts), dtype=bool)
            if trees:
                bits, sizes = trees.code_lengths([t.encode() for t in texts], words_only=True)
                keep = (bits.min(axis=1) <= reject_bits * sizes + margin) & [LETTER.search(t) is not None for t in texts]
            yield rows.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
