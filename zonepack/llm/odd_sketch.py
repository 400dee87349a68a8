"""Operator 13, MinHash near-duplicates verified by odd sketches, confirmed on full sets.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set has the 64-bit hashes of
its distinct 3-word shingles. Two documents link when 100 * intersection >= 85 * union. The result has each
document's component; the smallest doc_id of each is kept. ``width`` and ``percent`` set other numbers.

1. One map makes a digest of each set, its ``SAMPLES`` MinHash values, the keys of their bands of ``ROWS`` values, and the odd
   sketch: each (place, value) flips one of ``SKETCH_BITS`` bits. Equal sets form a class; the smallest doc_id stands for it.
   There are as many bands as make ``MISSED`` the chance that none of two just linked sets' bands agree.
2. Two sketches differ in at most two bits for each MinHash value in which two documents differ. A candidate whose sketches
   differ in more than ``most_apart`` bits is dropped: a linked pair differs so much with a chance below ``MISSED``.
3. Stars. The pivot of a key is the document that meets most others under its keys, so of many copies of one
   text with differences between each other it is that text. Each document is confirmed on full sets against the ``ROUNDS``
   pivots whose sketches are nearest to its own. A pivot's documents are dealt to blocks, and the pivot goes to
   each: a group of near copies costs its size, not its square.
4. Rest. Keys that still join two components: their documents meet in blocks of sketches, every two blocks
   in one task. Documents with a candidate of another component there, under the smallest key that both have,
   go to such blocks again with their sets; candidates are taken in the order of their sketches and confirmed on the sets, those
   in one component by then are passed over.
5. Components of all links, by stars.

No bucket is cut off: what the stars leave, the blocks find. Joins with sets are sort-merge joins at any size, so
that Spark splits skewed keys and larger input changes no plan.

No words or null text: n_shingles 0, component_id is the row's own doc_id, kept. One or two words: the whole
sequence is one shingle. Rows that repeat a doc_id with other texts count as one node of the link graph; each row
has its own n_shingles, and all are kept or none. A null doc_id takes no part: component_id null, kept. Empty table: no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.components import components
from zonepack.llm.jaccard_join import BLOCK, BLOCK_BYTES, FILTER_BITS, OP3_SQL, _across, _blocks, _cell, _id_filter, _labelled, _mixed, _tokens, linked, shingle_sets
from zonepack.llm.shared import Scratch, cuts, dealt_by, documents, groups, stage
from zonepack.llm.signature_tree import Components, signatures
from zonepack.llm.word_ids import take_turn

SHINGLE, PERCENT = 3, 85
SAMPLES, ROWS, SKETCH_BITS = 256, 4, 1024
MISSED = 1e-11
ROUNDS = 2


def bands_for(percent: int) -> int:
    """So many bands of ``ROWS`` values that two sets of this similarity share none with a chance below ``MISSED``."""
    return math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))


def most_apart(percent: int, samples: int) -> int:
    """Bits in which the sketches of two sets of this similarity differ at most, but for a chance below ``MISSED``."""
    other = max(1 - percent / 100, 1e-9)
    chance = [math.exp(math.lgamma(samples + 1) - math.lgamma(k + 1) - math.lgamma(samples - k + 1) + k * math.log(other) + (samples - k) * math.log(1 - other)) for k in range(samples + 1)]
    tail = 0.0
    for k in range(samples, 0, -1):
        tail += chance[k]
        if tail > MISSED:
            return 2 * k
    return 0


@cache
def _constants(samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random numbers: one to add to the hashes and an odd one to multiply them by for each sample."""
    pick = np.random.default_rng(20_240_613).integers(0, 1 << 64, (2, samples), dtype=np.uint64)
    return pick[0], pick[1] | np.uint64(1)


def minhashes(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """(set, sample): the smallest of the set's hashes under each sample's permutation. No set is empty."""
    tokens = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((samples, len(sets)), dtype=np.uint64)
    turned = np.empty_like(tokens)
    for k, (flip, odd) in enumerate(zip(*_constants(samples))):
        np.multiply(np.bitwise_xor(tokens, flip, out=turned), odd, out=turned)
        np.minimum.reduceat(turned, starts, out=out[k])
    return out.T


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """(set, band): a hash of the band's values and its place."""
    out = np.empty((len(values), bands), dtype=np.uint64)
    for band in range(bands):
        h = np.full(len(values), band + 1, dtype=np.uint64)
        for column in values[:, band * ROWS : (band + 1) * ROWS].T:
            h = _mixed((h + column) * np.uint64(0x9E3779B97F4A7C15))
        out[:, band] = h
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """(set, word): ``SKETCH_BITS`` bits, each set where an odd number of (place, value) falls."""
    place = np.arange(1, values.shape[1] + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = _cell(_mixed(values + place), SKETCH_BITS.bit_length() - 1) + np.arange(len(values))[:, None] * SKETCH_BITS
    odd = np.bincount(at.ravel(), minlength=len(values) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(values), SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def estimate(apart: int, samples: int = SAMPLES) -> float:
    """Similarity of two sets whose sketches differ in so many bits."""
    share = min(2 * apart / SKETCH_BITS, 1 - 1 / SKETCH_BITS)
    return 1 + SKETCH_BITS / (4 * samples) * math.log(1 - share)


def _signed(docs: DataFrame, width: int, bands: int, samples: int) -> DataFrame:
    """(doc_id, n, digest, keys, sketch) of every row; within a task keys and sketch are given once for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        known: dict[bytes, int] = {}
        for rows in cuts(batches):
            sets = shingle_sets(rows.column("text"), width)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            new = []
            for i, (doc_id, digest) in enumerate(zip(rows.column("doc_id").to_pylist(), digests)):
                if len(sets[i]) and doc_id is not None and known.get(digest, doc_id + 1) > doc_id:
                    if len(known) > 200_000:
                        known.clear()
                    known[digest] = doc_id
                    new.append(i)
            keys, sketches = np.full(len(sets), None, dtype=object), np.full(len(sets), None, dtype=object)
            if new:
                values = minhashes([sets[i] for i in new], samples)
                keys[new] = list(map(bytes, band_keys(values, bands).view(np.int64)))
                sketches[new] = list(map(bytes, odd_sketches(values)))
            columns = [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "keys", "sketch"])

    return documents(docs).mapInArrow(run, "doc_id long, n long, digest binary, keys binary, sketch binary")


def _key_rows(reps: DataFrame) -> DataFrame:
    """(key, doc_id, n): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(k.as_buffer(), dtype=np.int64) for k in batch.column("keys")]
            sizes = np.array([len(k) for k in keys], dtype=np.int64)
            each = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("doc_id", "n")]
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *each], ["key", "doc_id", "n"])

    return reps.select("doc_id", "n", "keys").mapInArrow(run, "key long, doc_id long, n long")


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, tokens) of the rows whose ids are in ``ids``, and of a few others that a bit table of fixed size lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            wanted = table[_cell(_mixed(batch.column("doc_id").to_numpy().astype(np.uint64)), FILTER_BITS)]
            for rows in cuts(iter([batch.filter(pa.array(wanted))])):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(rows.column("text"), width)], pa.binary())], ["doc_id", "tokens"])

    return documents(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, tokens binary").where(F.octet_length("tokens") > 0)


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), SKETCH_BITS // 64)


def _nearest(pairs: DataFrame, limit: int) -> DataFrame:
    """``pairs`` (doc_id, sketch, pivot, pivot_sketch) that are candidates, with ``apart``, the number of bits that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.bitwise_count(_sketches(batch.column("sketch")) ^ _sketches(batch.column("pivot_sketch"))).sum(axis=1).astype(np.int32)
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pivot"), pa.array(apart)], ["doc_id", "pivot", "apart"])
            yield rows.filter(pa.array(apart <= limit))

    return pairs.mapInArrow(run, "doc_id long, pivot long, apart int")


def _from_pivots(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the pivot of each (pivot, block) of ``rows`` (pivot, block, doc_id, tokens) to the block's other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "pivot", "block"):
            pivot, ids, sets = group.column("pivot")[0].as_py(), group.column("doc_id").to_pylist(), _tokens(group.column("tokens"))
            centre = [s for i, s in zip(ids, sets) if i == pivot]  # several where rows repeat its id
            found = [i for i, s in zip(ids, sets) if i != pivot and any(linked(c, s, percent) for c in centre)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([pivot] * len(found), pa.int64())], ["a", "b"])

    return dealt_by(rows, "pivot", "block").mapInArrow(run, "a long, b long")


def _candidates(group: pa.Table, percent: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, apart), i < j: rows of a (key, left, right) with other labels, fitting sizes and sketches, and no smaller key in
    common. Rows of one block are compared where it meets itself."""
    key, left, right = (group.column(c)[0].as_py() for c in ("key", "left", "right"))
    n, labels, own = (group.column(c).to_numpy() for c in ("n", "label", "own"))
    sketches = _sketches(group.column("sketch"))
    lists = [np.asarray(k, dtype=np.int64) for k in group.column("keys").to_pylist()]
    before, _ = signatures([k[: int(np.searchsorted(k, key))].view(np.uint64) for k in lists], 1 << 30)
    place = np.arange(len(n))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(n), 64):
        some = slice(begin, begin + 64)
        fits = (labels[some, None] != labels) & (100 * np.minimum(n[some, None], n) >= percent * np.maximum(n[some, None], n)) & (place[some, None] < place)
        if left != right:
            fits &= own[some, None] != own
        i, j = np.nonzero(fits)
        i += begin
        for at in range(0, len(i), 1 << 15):
            x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            apart = np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1).astype(np.int64)
            good = apart <= limit
            good[good] = ~(before[x[good]] & before[y[good]]).any(axis=1)
            out.append((x[good], y[good], apart[good]))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, dtype=np.int64),) * 3


def _meeting(rows: DataFrame, percent: int, limit: int) -> DataFrame:
    """(key, left, right, own, doc_id, label, n, sketch, keys) of the rows that have a candidate in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "key", "left", "right"):
            i, j, _ = _candidates(group, percent, limit)
            if len(i):
                met = np.zeros(len(group), dtype=bool)
                met[i], met[j] = True, True
                yield from group.filter(pa.array(met)).to_batches()

    columns = ["key", "left", "right", "own", "doc_id", "label", "n", "sketch", "keys"]
    return dealt_by(rows.select(columns), "key", "left", "right").mapInArrow(run, "key long, left int, right int, own int, doc_id long, label long, n long, sketch binary, keys array<long>")


def _confirmed(rows: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links (a, b) between components in the groups of ``rows`` (what ``_meeting`` gives, and tokens), nearest sketches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "key", "left", "right"):
            ids, sets = group.column("doc_id").to_pylist(), _tokens(group.column("tokens"))
            i, j, apart = _candidates(group, percent, limit)
            order = np.argsort(apart, kind="stable")
            known, found = Components(group.column("label").to_pylist()), []
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                if known.find(x) != known.find(y) and linked(sets[x], sets[y], percent):
                    known.union(x, y)
                    found.append((ids[x], ids[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return dealt_by(rows, "key", "left", "right").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    bands = bands_for(percent)
    samples = max(SAMPLES, bands * ROWS)
    limit = most_apart(percent, samples)
    signed = scratch.stage(_signed(docs, width, bands, samples), "signed")
    light = stage(signed.select("doc_id", "n", "digest"), "light")  # read by the result
    first = F.min_by(F.struct("doc_id", "n", "keys", "sketch"), "doc_id").alias("first")
    reps = scratch.stage(signed.where("keys is not null").groupBy("digest").agg(first).select("first.*", "digest"), "reps")
    copies = light.where("doc_id is not null and n > 0").join(reps.select("digest", F.col("doc_id").alias("rep")).hint("merge"), "digest")
    links = scratch.stage(copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "links")

    rows = _key_rows(reps)
    repeated = rows.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = scratch.stage(rows.join(repeated.hint("merge"), "key"), "shared")
    weight = shared.groupBy("doc_id").agg(F.sum("rows").alias("weight"))
    pivots = shared.join(weight.hint("merge"), "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("pivot"))
    pairs = shared.select("key", "doc_id").join(pivots.hint("merge"), "key").where("doc_id <> pivot").select("doc_id", "pivot").distinct()
    sketches = reps.select("doc_id", "sketch")
    pairs = pairs.join(sketches.hint("merge"), "doc_id").join(sketches.select(F.col("doc_id").alias("pivot"), F.col("sketch").alias("pivot_sketch")).hint("merge"), "pivot")
    near = F.slice(F.array_sort(F.collect_set(F.struct("apart", "pivot"))), 1, ROUNDS)
    nearest = _nearest(pairs.select("doc_id", "sketch", "pivot", "pivot_sketch"), limit).groupBy("doc_id").agg(near.alias("near"))  # a document has no more pivots than bands
    stars = scratch.stage(nearest.select("doc_id", F.explode("near.pivot").alias("pivot")), "stars")

    sets = scratch.stage(_sets_of(docs, shared.select("doc_id").distinct(), width), "sets")
    sizes = stars.join(reps.select("doc_id", "n").hint("merge"), "doc_id").groupBy("pivot").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).withColumn("blocks", _blocks(BLOCK, 8))
    dealt = stars.join(sizes.select("pivot", "blocks").hint("merge"), "pivot").select("pivot", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "doc_id")
    centres = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("doc_id"))
    found = scratch.stage(_from_pivots(sets.join(dealt.union(centres).hint("merge"), "doc_id").select("pivot", "block", "doc_id", "tokens"), percent), "found")
    scratch.drop(signed, stars)
    labels = components(found)

    rest = _across(_labelled(shared.select("doc_id", "n", "key").distinct(), labels)).withColumn("blocks", _blocks(4 * BLOCK, SKETCH_BITS / 8 / 64))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = scratch.stage(rest.select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "doc_id", "label", "n"), "rest")
    scratch.drop(shared)
    lists = rest.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    met = scratch.stage(_meeting(rest.join(lists.hint("merge"), "doc_id").join(sketches.hint("merge"), "doc_id"), percent, limit), "met")
    more = scratch.stage(_confirmed(sets.join(met.hint("merge"), "doc_id").select(*met.columns, "tokens"), percent, limit), "more")
    scratch.drop(sets, met, rest, reps)
    labels = components(reduce(DataFrame.union, [found, more, links]))
    scratch.clear()
    out = _labelled(light.select("doc_id", F.col("n").alias("n_shingles")), labels).withColumnRenamed("label", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The n-gram join's SQL with this threshold: all pairs that share a shingle, for tables of thousands of rows.
OP13_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({OP3_SQL.replace('>= 90', '>= 85')})"
