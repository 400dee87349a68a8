"""Operator 9, packing: cost-balanced sequences of token ids.

The cost of a sequence is estimated as ``LINEAR * tokens + QUADRATIC * sum(piece length squared)``:
attention stays inside a document. Documents go in descending order to the lowest-cost sequence
with remaining token capacity, whole if one of the lowest few can take it, else cut there; the rest
goes back among the documents by its own length.

Packing happens inside each input partition, over windows of ``WINDOW_TOKENS`` ids, so ids are made
once and nothing is shuffled. A window of T ids opens T // capacity full sequences, and sequences of
power-of-two capacity for what is left over, which are used last: no sequence needs padding.
Sequence ids are partition id * 2**40 + a running number. File scans give the same rows to the same
partition on a retry, so a lost executor's share comes out alike.

Null text is empty: one piece that holds only the end id. Repeated rows and null ids: each row is
packed by itself. Empty table: no pieces. Other columns are not read. A document longer than a
window makes a window of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from zonepack.llm.shared import cuts, documents
from zonepack.llm.word_ids import tokenizer, vocabulary_path

CAPACITY = 2048
END_ID = 1
WINDOW_TOKENS = 4 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Lowest-cost sequences that are asked for room before a document is cut.
TRIES = 8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, capacity: int) -> list[int]:
    """Full sequences, then powers of two that add up to the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences end up exactly full."""
    room = capacities(sum(lengths), capacity)
    used = [0] * len(room)
    sequences = [(int(size < capacity), 0.0, s) for s, size in enumerate(room)]
    heapify(sequences)
    left = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapify(left)
    pieces = []
    while left:
        n, d, start = heappop(left)
        n = -n
        first = chosen = heappop(sequences)
        passed = []
        if n <= capacity and room[first[2]] - used[first[2]] < n:
            while sequences and len(passed) < TRIES:
                other = heappop(sequences)
                if room[other[2]] - used[other[2]] >= n:
                    chosen = other
                    passed.append(first)
                    break
                passed.append(other)
            for other in passed:
                heappush(sequences, other)
        short, cost, s = chosen
        taken = min(n, room[s] - used[s])
        pieces.append((d, start, taken, s, used[s]))
        used[s] += taken
        if used[s] < room[s]:
            heappush(sequences, (short, cost + LINEAR * taken + QUADRATIC * taken * taken, s))
        if taken < n:
            heappush(left, (taken - n, d, start + taken))
    return pieces


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece; a piece's ids are those from ``start`` on of its document, ``end_id`` included."""

    def pieces_of(ids: list[int | None], tokens: list[np.ndarray], base: int) -> tuple[pa.RecordBatch, int]:
        rows = assign([len(t) for t in tokens], capacity)
        columns = [
            [ids[d] for d, *_ in rows],
            [start for _, start, *_ in rows],
            [n for _, _, n, *_ in rows],
            [zlib.crc32(tokens[d][start : start + n]) for d, start, n, *_ in rows],
            [len(tokens[d]) for d, *_ in rows],
            [base + s for *_, s, _ in rows],
            [at for *_, at in rows],
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), base + 1 + max((r[3] for r in rows), default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = tokenizer(vocabulary).encode
        base = TaskContext.get().partitionId() << 40
        ids, tokens, total = [], [], 0
        for rows in cuts(batches):
            found, ends = tokens_of(rows.column("text"), end_id)
            for doc_id, own in zip(rows.column("doc_id").to_pylist(), np.split(found, ends[:-1])):
                ids.append(doc_id)
                tokens.append(own)
                total += len(own)
                if total >= WINDOW_TOKENS:
                    out, base = pieces_of(ids, tokens, base)
                    yield out
                    ids, tokens, total = [], [], 0
        if ids:
            yield pieces_of(ids, tokens, base)[0]

    return documents(docs).mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"))
