"""Operator 7, token-id output: canonical length-limited Huffman files.

Writing takes three steps. Ids of every whole text are staged once, with the counts of each id in a task;
counts over all documents give code lengths by package-merge, no longer than ``max_bits``, and canonical codes
follow from the lengths alone. Each document is then coded by itself (byte-aligned), dealt to
ranges of doc_id of about ``BUCKET_BYTES`` and sorted, and a range's documents are joined to blocks of about
``BLOCK_BYTES``. Each range is one partition; an id that very many rows repeat is spread over several.

The format, below one folder: ``codes`` (token_id, bits) and ``blocks`` in one folder per range
(``bucket=...``, ascending), rows in order of ``block``. A block has its documents' ids and token
counts, the bit string, and a bit offset for every ``STRIDE`` ids of a document, so it is decoded
without any other. Spark's writer commits the files, so a lost task leaves none.

Reading looks up ``max_bits`` bits at once in a table of (id, bits). All stretches between
checkpoints of a block advance together, one id a step.

Null text is empty (the end id alone). Null doc_id sorts first. Repeated rows are coded each; among
equal doc_ids the order is that of the coded bytes. Empty table: files without blocks, no rows.
Other columns are not read. Only code tables and range bounds reach the driver: at most one entry an
id of the vocabulary, and one a range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.shared import cuts, documents, parallelism, stage, stage_path
from zonepack.llm.word_ids import take_turn, tokenizer, vocabulary_path

END_ID = 1
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
NO_ID = -(1 << 63)
STRIDE = 256
LEAST_BITS = 12
BLOCKS = "bucket int, block long, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, checkpoints binary, payload binary"


def limited_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Huffman code lengths of at most ``max_bits`` for positive ``counts`` (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        by_weight = np.argsort(merged, kind="stable")
        levels.append(by_weight < n)
        merged = merged[by_weight]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        lengths[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes of ids, from (token_id, bits) alone: shorter first, then by id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        by = np.lexsort((ids, bits))
        ids, bits = ids[by].astype(np.int64), bits[by].astype(np.int64)
        self.max_bits = int(bits.max()) if len(bits) else 1
        spans = np.left_shift(1, self.max_bits - bits)
        aligned = np.cumsum(spans) - spans
        self.bits = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint64)
        self.codes = np.zeros_like(self.bits)
        self.bits[ids] = bits.astype(np.uint64)
        self.codes[ids] = np.right_shift(aligned, self.max_bits - bits).astype(np.uint64)
        self.table_id = np.zeros(1 << self.max_bits, dtype=np.uint32)
        self.table_bits = np.ones(1 << self.max_bits, dtype=np.uint8)
        filled = int(spans.sum())
        self.table_id[:filled] = np.repeat(ids, spans)
        self.table_bits[:filled] = np.repeat(bits, spans)

    def encode(self, ids: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The documents' bytes and where each one's end; the bit offsets of its every ``stride``-th id and where
        those of each document end. No length may be 0."""
        bits = self.bits[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        first = ends - lengths
        before = np.cumsum(bits) - bits
        size = -(-np.add.reduceat(bits, first) // 8)
        begin = np.cumsum(size) - size
        inside = before - np.repeat(before[first], lengths)
        at = inside + np.repeat(begin * 8, lengths)
        word, off = at >> 6, at & 63
        over = off + bits - 64
        codes = self.codes[ids]
        high = np.where(over > 0, codes >> np.maximum(over, 0).astype(np.uint64), codes << np.maximum(-over, 0).astype(np.uint64))
        out = np.zeros(int(size.sum() // 8 + 2), dtype=np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(high, starts)
        spill = np.flatnonzero(over > 0)
        out[word[spill] + 1] |= codes[spill] << (64 - over[spill]).astype(np.uint64)
        stretches = -(-lengths // stride)
        mark_ends = np.cumsum(stretches)
        nth = np.arange(int(mark_ends[-1])) - np.repeat(mark_ends - stretches, stretches)
        marks = inside[np.repeat(first, stretches) + nth * stride]
        return out.astype(">u8").tobytes()[: int(size.sum())], np.cumsum(size), marks, mark_ends

    def decode(self, payload: bytes, checkpoints: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> np.ndarray:
        """The ids of a block; ``checkpoints`` are bit offsets of stretches of at most ``stride`` ids."""
        raw = np.concatenate([np.frombuffer(payload, dtype=np.uint8), np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        ends = np.cumsum(lengths)
        stretches = -(-lengths // stride)
        owner = np.repeat(np.arange(len(lengths)), stretches)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        first = (ends - lengths)[owner] + nth * stride
        todo = np.minimum(ends[owner] - first, stride)
        order = np.argsort(-todo, kind="stable")
        first, todo, at = first[order], todo[order], checkpoints[order].astype(np.int64)
        live = np.searchsorted(-todo, -np.arange(1, int(todo.max(initial=0)) + 1), side="right")
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype="<u4")
        mask, shift = np.uint32((1 << self.max_bits) - 1), 32 - self.max_bits
        for step, n in enumerate(live.tolist()):
            here = at[:n]
            seen = window[here >> 3] >> (shift - (here & 7)).astype(np.uint32) & mask
            out[first[:n] + step] = self.table_id[seen]
            here += self.table_bits[seen]
        return out


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary value of each stretch of ``data``; its buffer is used as it is."""
    offsets = np.concatenate([[0], ends]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def joined(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of all values of a column without nulls, and where each value's end."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])), (offsets[1:] - offsets[0]).astype(np.int64)


def encode(docs: DataFrame, vocabulary: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of every whole text, each document closed by ``end_id``, to files below ``path``."""
    spark = docs.sparkSession
    size = tokenizer(vocabulary).library.get_vocab_size()
    kind = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = tokenizer(vocabulary).encode, np.zeros(max(size, end_id + 1), dtype=np.int64)
        names = ["doc_id", "ids", "counts"]
        for rows in cuts(batches):
            ids, ends = of(rows.column("text"), end_id)
            total += np.bincount(ids, minlength=len(total))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), binaries(ids.astype(kind), ends), pa.nulls(len(ends), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("counts"):
                total = np.frombuffer(value.as_buffer(), dtype=np.int64)
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["token_id", "n"])

    staged = stage(documents(docs).mapInArrow(ids_of, "doc_id long, ids binary, counts binary"), "token-ids", compression="lz4")
    counts = staged.select("counts").where("counts is not null").mapInArrow(counts_of, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n")).toPandas()
    token_ids, n = counts["token_id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    bits = limited_lengths(n, max(LEAST_BITS, int(len(n)).bit_length() + 1))
    codes = list(zip(token_ids.tolist(), bits.tolist()))
    spark.createDataFrame(codes, "token_id long, bits long").coalesce(1).write.parquet(f"{path}/codes")

    rows = staged.where("counts is null").select("doc_id", "ids")
    buckets = max(parallelism(spark), int((n * bits).sum()) // (8 * BUCKET_BYTES) + 1)
    edges = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if codes else []
    bounds = np.array(edges, dtype=np.float64)
    shared = spark.sparkContext.broadcast((token_ids, bits))

    def bucket_of(doc_ids: np.ndarray, payloads: pa.Array) -> np.ndarray:
        """The range of each id. An id that is a bound may go to any range that this bound touches."""
        first, last = (np.searchsorted(bounds, doc_ids.astype(np.float64), side=side) for side in ("left", "right"))
        exact = (np.abs(doc_ids) < 1 << 53) | (doc_ids == NO_ID)  # as a float the id is itself
        for i in np.flatnonzero(exact & (last > first)).tolist():
            last[i] = first[i] + zlib.crc32(payloads[i].as_buffer()) % (last[i] - first[i] + 1)
        return last

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("codes")
        code = Code(*shared.value)
        for part in cuts(batches, "ids", 1 << 19):
            arrays = [np.frombuffer(v.as_buffer(), dtype=kind) for v in part.column("ids")]
            sizes = np.array([len(a) for a in arrays])
            raw, ends, marks, mark_ends = code.encode(np.concatenate(arrays), sizes)
            doc_ids, payload = part.column("doc_id"), binaries(np.frombuffer(raw, dtype=np.uint8), ends)
            bucket = bucket_of(doc_ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), payload)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), doc_ids, pa.array(sizes, pa.int64()), binaries(marks.astype("<u4"), mark_ends), payload], ["bucket", "doc_id", "n", "marks", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block is a slice of a batch in one bucket: its bytes lie side by side in the column's buffer."""
        take_turn("codes")
        last, block, first = None, 0, 0
        for part in cuts(batches, "payload", BLOCK_BYTES):
            buckets = part.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), part.num_rows]
            for begin, end in zip(edges, edges[1:]):
                rows = part.slice(begin, end - begin)
                if buckets[begin] != last:
                    last, block, first = buckets[begin], 0, 0
                payload, ends = joined(rows.column("payload"))
                marks, mark_ends = joined(rows.column("marks"))
                stretches = np.diff(mark_ends, prepend=0) // 4
                marks = np.frombuffer(marks, dtype="<u4").astype("<u8") + np.repeat((np.concatenate([[0], ends[:-1]]) * 8).astype(np.uint64), stretches)
                n = pc.sum(rows.column("n")).as_py()
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                columns = [pa.array([v], t) for v, t in ((last, pa.int32()), (block, pa.int64()), (first, pa.int64()), (n, pa.int64()))]
                columns += [whole(rows.column("doc_id")), whole(rows.column("n")), pa.array([marks.tobytes()], pa.binary()), pa.array([payload.to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCKS.split(", ")])
                block, first = block + 1, first + n

    (
        rows.mapInArrow(coded, "bucket int, doc_id long, n long, marks binary, payload binary")
        .repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "payload")
        .mapInArrow(blocks, BLOCKS)
        .write.partitionBy("bucket")
        .option("compression", "uncompressed")
        .parquet(f"{path}/blocks")
    )


def decode(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of all documents in the files below ``path``; ``ids`` are little-endian uint32."""
    return _read(spark, path, "ids binary", binaries)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the ids are decoded and summed, not returned."""
    return _read(spark, path, "ids_crc32 long", lambda ids, ends: pa.array([zlib.crc32(own) for own in np.split(ids, ends[:-1])], pa.int64()))


def _read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    codes = spark.read.schema("token_id long, bits long").parquet(f"{path}/codes").toPandas()
    found = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = dict(sorted(tuple(r) for r in found.groupBy("bucket").agg(F.sum("n_tokens")).collect()))
    offsets, total = {}, 0
    for bucket, n in totals.items():
        offsets[bucket], total = total, total + n
    shared = spark.sparkContext.broadcast((codes["token_id"].to_numpy(), codes["bits"].to_numpy(), offsets))
    name, sql_type = column.split()
    more = [] if sql_type == "binary" else ["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("codes")
        ids, bits, offset = shared.value
        code = Code(ids, bits)
        for batch in cuts(batches, "payload", 1):
            bucket, first = batch.column("bucket")[0].as_py(), batch.column("first_token")[0].as_py()
            lengths = batch.column("doc_tokens").flatten().to_numpy()
            tokens = code.decode(batch.column("payload")[0].as_buffer(), np.frombuffer(batch.column("checkpoints")[0].as_buffer(), dtype="<u8"), lengths)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            columns = [batch.column("doc_ids").flatten(), pa.array(starts + first + offset[bucket]), *([pa.array(lengths)] if more else []), value(tokens, ends)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", *more, name])

    schema = ", ".join(["doc_id long, start long", *(f"{c} long" for c in more), column])
    return found.select("bucket", "first_token", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(run, schema)


def op7_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "token-files")
    encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("word_bpe_49k.json"), path)
    return digests(spark, path)
