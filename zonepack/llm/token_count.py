"""Operator 2, token counts: byte-pair merging with a heap and a linked list.

The vocabulary's ranked merges are the model. The symbols of a piece of text form a doubly linked
list; a heap holds its adjacent pairs by rank (then position). The lowest is popped and merged
again and again, stale entries are passed over, and the new neighbours are pushed. The count is the
number of initial symbols less the number of merges; no ids are made. Work is O(n log n) in the
length of a piece, so a very long unbroken string costs little more per byte than prose.

One map over the rows, no shuffle. A worker remembers the counts of words it has met.

Null text: 0 bytes, 0 tokens. Empty or blank text: 0 tokens. Repeated rows, null ids: one row each,
as they come. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.shared import cuts, documents
from zonepack.llm.word_ids import WordTokenizer, _Kept, by_letters, byte_level, take_turn, vocabulary_path, words_of

LIMIT = 2048


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges of the ranked pairs, lowest rank first, leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heappop(heap)
        j = right[i]
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two is gone or has grown
        symbols[i], symbols[j] = a + b, ""
        right[i] = k = right[j]
        merges += 1
        if k < n:
            left[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := left[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heappush(heap, (rank, h, symbols[h], symbols[i]))
    return n - merges


class MergeCounter:
    """Counts of one vocabulary file; pieces are split as the file's own normalizer and splitter do."""

    def __init__(self, path: str):
        self.splitter = WordTokenizer(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.known = model["vocab"].keys()
        self.letters = _Kept(lambda low: self._piece(byte_level(low)))
        self.odd = _Kept(self._odd)

    def _piece(self, piece: str) -> int:
        symbols = [*piece[:-1], piece[-1] + self.suffix]
        if any(s not in self.known for s in symbols):
            symbols = [s for s in symbols if s in self.known]  # no unknown token: the library leaves them out
        return merged_count(symbols, self.ranks)

    def _odd(self, word: str) -> int:
        if (pieces := self.splitter.split(word)) is None:  # special tokens count one each, what lies between counts as usual
            count, rest = 0, [word]
            for s in self.splitter.special:
                parts = [p.split(s) for p in rest]
                count += sum(len(p) - 1 for p in parts)
                rest = [x for p in parts for x in p if x]
            return count + sum(map(self._odd, rest))
        return sum(map(self._piece, pieces))

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column."""
        words, index, ends = words_of(column)
        each = np.array(by_letters(words, self.letters, self.odd), dtype=np.int64)[index]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[ends], prepend=0)

    def count(self, text: str) -> int:
        return int(self.counts(pa.array([text]))[0])


_open: dict[str, MergeCounter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is the path of a tokenizer file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("counts")
        if vocabulary not in _open:
            _open.clear()
            _open[vocabulary] = MergeCounter(vocabulary)
        counter = _open[vocabulary]
        for rows in cuts(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), pa.array(counter.counts(rows.column("text")))], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
