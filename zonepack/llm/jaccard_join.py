"""Operator 3, n-gram Jaccard join: signature trees over shingle sets, exact.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set has the
64-bit hashes of its distinct 3-word shingles. Two documents link when
100 * intersection >= 90 * union. The result has each document's component. ``width`` and ``percent``
(above 50) set other numbers; the steps below are told for 3 and 90.

1. Sets that are equal form a class; its smallest doc_id stands for it.
2. A set of which more than a tenth is in no other class links with nothing. This is tested on the
   shingles whose hash is in the lowest ``1 / probe_part(percent)``: they are grouped over all documents, and a set
   with n - ceil(0.9 n) + 1 such shingles of its own is done. What passages many documents share does
   not matter here.
3. Prefix keys of the remaining sets. Their shingles are ordered by how many of these sets have them,
   rarest first: a table of ``RARITY_BITS`` bits of counters, made on the executors, says it roughly, and
   any order is right if it is one for all. Two linked sets share one of their first n - ceil(0.9 n) + 1
   shingles, and it is among the first n - ceil(1.8 / 1.9 n) + 1 of the smaller one. So a passage that many
   documents share makes keys only where documents have little else. Documents that share such a key are candidates, if what each
   has from its first common key on is enough for a link (``may_link``).
4. Collapse: each candidate that shares many of its keys goes with its set to ``ROUNDS`` of them. A group is dealt to
   blocks of about ``BLOCK`` rows and ``BLOCK_BYTES``, and the key's pivot, of all sets that have it the one whose shingles
   are the most common, goes to every block: where many texts are copies of one and differ from each other, it is that one. In a block the
   pivot is compared with all, then a signature tree is traversed with itself, pairs that its bounds leave are
   compared exactly, and pairs inside a known component are passed over. So a group of near copies costs its
   size, not its square.
5. Rest: keys that still join two components. Two documents are compared under their smallest common key, so
   those that have a partner under a key go there with their sets. Every two blocks of a group meet in a task,
   where signature trees look for links across components in the same way.
6. Components of all links, by stars.

Joins with sets are sort-merge joins at any size: Spark splits skewed keys, and larger input changes no plan.

Steps 3 and 5 consider every pair that can link, so no link between components is lost. Shingles are
compared by 64-bit hashes and equal sets by 128-bit digests: exact but for collisions of these.

No words or null text: n_shingles 0, component_id is the row's own doc_id, no links. One or two words:
the whole sequence is one shingle. Rows that repeat a doc_id with other texts count as one node of the
link graph; each row has its own n_shingles. A null doc_id takes no part: component_id null. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.components import components
from zonepack.llm.shared import Scratch, cuts, dealt_by, documents, groups, parallelism, stage, to_all, without_ids
from zonepack.llm.signature_tree import pairs, signatures
from zonepack.llm.word_ids import strings, take_turn, words_of

SHINGLE = 3
PERCENT = 90
ROUNDS = 2
#: Near copies share about half of their keys; a set that shares less than this part of them is left to step 5.
LIKELY = 0.35
BLOCK = 512
BLOCK_BYTES = 16 << 20
#: Bits of a probed shingle: two that are one then are not a set's own, so more sets pass, and the rest is zeros, which shuffle for little.
PROBED = np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)
FILTER_BITS = 24
PASS_BITS, PROBES = 25, 3
RARITY_BITS = 24
CHUNK_BITS = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)



def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _C
    return h ^ h >> np.uint64(33)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; of the whole sequence if it is shorter."""
    words, index, ends = words_of(pc.ascii_lower(column))
    coded = np.fromiter(map(xxhash.xxh64_intdigest, strings(words)), dtype=np.uint64, count=len(words))[index]

    def mixed(coded: np.ndarray, width: int) -> np.ndarray:
        h = np.full(max(0, len(coded) - width + 1), width, dtype=np.uint64)
        for k in range(width):
            h = _mixed(h * _A + coded[k : len(h) + k] * _B)
        return h

    whole = mixed(coded, width)
    found, begin = [], 0
    for end in ends.tolist():
        found.append(np.unique(whole[begin : end - width + 1] if end - begin >= width else mixed(coded[begin:end], end - begin)[: end - begin]))
        begin = end
    return found


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def key_count(n, percent: int = PERCENT):
    """n - ceil(percent / 100 n) + 1, of a number or a column: that many shingles of a set, at least one of
    which every linked set has."""
    return n - (percent * n + 99 - (percent * n + 99) % 100) / 100 + 1


def index_count(n: int, percent: int = PERCENT) -> int:
    """The same for the smaller of two linked sets: the overlap is at least 2 p / (100 + p) of it."""
    return n + -(2 * percent * n) // (100 + percent) + 1


def probe_part(percent: int) -> int:
    """One in so many shingles is probed: so many more than the own shingles that step 2 asks for that few sets pass it by chance."""
    return 4 if percent >= 90 else 3 if percent >= 80 else 2


def _light(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, probe) of every row. ``probe`` has the set's shingles in the lowest part of the
    hashes; within a task it is given once for equal sets, else it is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        known: dict[bytes, int] = {}
        end = np.uint64((1 << 64) // probe_part(percent))
        for rows in cuts(batches):
            digests, sizes, probes = [], [], []
            for doc_id, tokens in zip(rows.column("doc_id").to_pylist(), shingle_sets(rows.column("text"), width)):
                digest = xxhash.xxh3_128_digest(tokens.tobytes())
                new = len(tokens) and doc_id is not None and known.get(digest, doc_id + 1) > doc_id
                if new:
                    if len(known) > 200_000:
                        known.clear()
                    known[digest] = doc_id
                digests.append(digest)
                sizes.append(len(tokens))
                probes.append((tokens[: int(np.searchsorted(tokens, end))] & PROBED).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(probes, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "probe"])

    return documents(docs).mapInArrow(run, "doc_id long, n long, digest binary, probe array<long>")


def _own_shingles(light: DataFrame, percent: int) -> DataFrame:
    """(class, own): how many probed shingles no other class has."""
    rows = light.select(F.xxhash64("digest").alias("class"), F.explode("probe").alias("shingle"))
    of_one = rows.groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("last")).where("class = last")
    return of_one.groupBy("class").agg(F.count("*").alias("own"))


def _id_filter(ids: DataFrame, bits: int = FILTER_BITS, probes: int = 1) -> np.ndarray:
    """A bit table of fixed size over doc_ids, ``probes`` bits an id: False in one means that the id is not in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            for cells in _id_cells(batch.column("doc_id"), bits, probes):
                table[cells] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    table = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for row in ids.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        table |= np.frombuffer(row.bits, dtype=np.uint8)
    return table


def _id_cells(ids: pa.Array, bits: int, probes: int) -> Iterator[np.ndarray]:
    h = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    for _ in range(probes):
        yield _cell(h := _mixed(h), bits)


def _passed(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows whose doc_id the table of ``_id_filter(ids, PASS_BITS, PROBES)`` passes."""
    for batch in batches:
        kept = np.ones(batch.num_rows, dtype=bool)
        for cells in _id_cells(batch.column("doc_id"), PASS_BITS, PROBES):
            kept &= (table[cells >> 3] >> (7 - (cells & 7)) & 1).astype(bool)
        yield batch.filter(pa.array(kept))


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, tokens) of the rows whose ids are in ``ids``, and of few others, as a bit table of fixed size says. Others
    do no harm: they are compared like the rest. So sets are not shuffled before it is known which have candidates."""
    shared = docs.sparkSession.sparkContext.broadcast(_id_filter(ids, PASS_BITS, PROBES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        for rows in cuts(_passed(batches, shared.value)):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(rows.column("text"), width)], pa.binary())], ["doc_id", "tokens"])

    return documents(docs).where("doc_id is not null").mapInArrow(run, "doc_id long, tokens binary").where(F.octet_length("tokens") > 0)


def _with_sets(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ...) with their tokens; of the sets only those that the bit table passes are shuffled."""
    shared = sets.sparkSession.sparkContext.broadcast(_id_filter(rows.select("doc_id"), PASS_BITS, PROBES))
    return sets.mapInArrow(lambda batches: _passed(batches, shared.value), sets.schema).join(rows.hint("merge"), "doc_id")


def _rarity(sets: DataFrame) -> np.ndarray:
    """For each cell of hashes, about four times the logarithm of the number of ``sets`` that have a shingle in
    it; 0 where it is one. A table of fixed size: counted by the tasks, summed by the shuffle in chunks."""
    cells = 1 << RARITY_BITS - CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << RARITY_BITS, dtype=np.uint8)  # a task counts up to 255
        for batch in batches:
            for tokens in _tokens(batch.column("tokens")):
                at = _cell(tokens, RARITY_BITS)
                table[at] += table[at] < 255
        found = [k for k in range(cells) if table[k << CHUNK_BITS : (k + 1) << CHUNK_BITS].any()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([zlib.compress(table[k << CHUNK_BITS : (k + 1) << CHUNK_BITS].tobytes(), 1) for k in found], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                more = np.frombuffer(zlib.decompress(counts), dtype=np.uint8).astype(np.uint64)
                sums[chunk] = sums[chunk] + more if chunk in sums else more
        coded = [np.minimum(127, 4 * np.log2(np.maximum(v, 1))).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(coded, pa.binary())], ["chunk", "coded"])

    out = np.zeros((cells, 1 << CHUNK_BITS), dtype=np.uint8)
    counted = sets.select("tokens").mapInArrow(count, "chunk int, counts binary").repartition(min(cells, parallelism(sets.sparkSession)), "chunk")
    for row in counted.mapInArrow(add, "chunk int, coded binary").toLocalIterator():
        out[row.chunk] = np.frombuffer(row.coded, dtype=np.uint8)
    return out.ravel()


def _keys(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, key, pos, leads, common): the keys of each set that others may share, numbers in the order of rarity, and how many
    of the set's shingles come before; ``leads`` if it may be the key of the smaller of two linked sets; ``common`` is how common the
    set's shingles are. A key is the rarity and 56 bits of the hash: should two shingles be one key, there are more candidates."""
    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = batch.slice(begin, 64)
                ids, sizes, keys, at, leads, common = [], [], [], [], [], []
                for doc_id, tokens in zip(rows.column("doc_id").to_pylist(), _tokens(rows.column("tokens"))):
                    rarity = shared.value[_cell(tokens, RARITY_BITS)]
                    n, most = len(tokens), int(key_count(len(tokens), percent))
                    first = np.argsort(rarity, kind="stable")[:most]  # tokens are sorted: ties go by hash
                    first = first[rarity[first] > 0] if (lone := int(np.count_nonzero(rarity == 0))) < most else first[:0]
                    ids.append(np.full(len(first), doc_id))
                    sizes.append(np.full(len(first), n))
                    keys.append(rarity[first].astype(np.int64) << 56 | (tokens[first] >> np.uint64(8)).astype(np.int64))
                    at.append(np.arange(lone, lone + len(first)))
                    leads.append(at[-1] < index_count(n, percent))
                    common.append(np.full(len(first), rarity.mean()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, sizes, keys, at, leads, common)], ["doc_id", "n", "key", "pos", "leads", "common"])

    return sets.mapInArrow(run, "doc_id long, n long, key long, pos long, leads boolean, common double")


def may_link(n, pos, other_n, other_pos, percent: int, least=F.least):
    """Can two sets of these sizes link whose first common key has these positions in them? What comes before it they have not in
    common, so the overlap is at most what is left of either; it also decides whether the sizes fit."""
    return (100 + percent) * least(n - pos, other_n - other_pos) >= percent * (n + other_n)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _tokens(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Views of the column's buffers."""
    return [np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in column]


def _linking(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    """Links (a, b) inside the groups by ``keys`` of ``rows`` (keys..., doc_id, label, is_pivot, tokens): enough to join
    what links and has not the same label. A group's pivot, if it has one, is compared with all first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        for group in groups(batches, *keys):
            ids, labels, sets = group.column("doc_id").to_pylist(), group.column("label").to_pylist(), _tokens(group.column("tokens"))
            found: list[tuple[int, int]] = []
            if True in (is_pivot := group.column("is_pivot").to_pylist()):
                pivot = is_pivot.index(True)
                found = [(pivot, i) for i in range(len(sets)) if i != pivot and linked(sets[pivot], sets[i], percent)]
                joined = {labels[i] for _, i in found}
                labels = [labels[pivot] if x in joined else x for x in labels]
            if len(set(labels)) > 1:
                bits, slack = signatures(sets, BLOCK_BYTES // 4)
                found += pairs(np.array([len(s) for s in sets]), bits, slack, labels, percent, lambda i, j: linked(sets[i], sets[j], percent))
            found = [(ids[i], ids[j]) for i, j in found if ids[i] != ids[j]]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return dealt_by(rows, *keys).mapInArrow(run, "a long, b long")


def _needed(rows: DataFrame, percent: int) -> DataFrame:
    """Of ``rows`` (key, left, right, doc_id, label, n, pos, keys) those with a partner in their group that may link: of
    another label, of fitting sizes and positions, and with no smaller key in common, under which the two meet as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        for group in groups(batches, "key", "left", "right"):
            group = group.combine_chunks()
            key, n, pos = group.column("key")[0].as_py(), group.column("n").to_numpy(), group.column("pos").to_numpy()
            labels = np.unique(group.column("label").to_numpy(), return_inverse=True)[1]
            lists = [np.asarray(k) for k in group.column("keys").to_numpy()]
            bits, _ = signatures([k[: int(np.searchsorted(k, key))] for k in lists], 1 << 30)
            partner = np.zeros(len(n), dtype=bool)
            for begin in range(0, len(n), 64):
                some = slice(begin, begin + 64)
                fits = (labels[some, None] != labels) & may_link(n[some, None], pos[some, None], n, pos, percent, np.minimum)
                at, other = np.nonzero(fits)
                apart = ~(bits[some][at] & bits[other]).any(axis=1)
                partner[begin + at[apart]] = True
            yield from group.select(["key", "left", "right", "doc_id", "label"]).filter(pa.array(partner)).to_batches()

    return dealt_by(rows, "key", "left", "right").mapInArrow(run, "key long, left int, right int, doc_id long, label long")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def _across(rows: DataFrame) -> DataFrame:
    """``rows`` of the keys that have two labels or more, with the number of the key's rows and of their
    shingles; of keys with the same documents (the same numbers and two sums of their hashes) one is kept."""
    sums = [F.sum(F.xxhash64("doc_id", F.lit(seed)).cast("decimal(38,0)")).alias(f"sum{seed}") for seed in (1, 2)]
    keys = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("size"), *sums).where("low < high")
    return rows.join(keys.groupBy("rows", "size", "sum1", "sum2").agg(F.min("key").alias("key")).select("key", "rows", "size"), "key")


def _blocks(most_rows: int, token_bytes: float):
    """Number of blocks of a key's rows: of so many rows and of ``BLOCK_BYTES`` each."""
    return F.ceil(F.greatest(F.col("rows") / most_rows, F.col("size") * token_bytes / BLOCK_BYTES)).cast("int")


def join(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    probed = scratch.stage(_light(docs, width, percent), "probed")
    light = stage(probed.select("doc_id", "n", "digest"), "light")  # read by the result
    classes = scratch.stage(light.where("doc_id is not null and n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    keys = key_count(F.col("n"), percent).cast("int")
    rows = probed.where("probe is not null").join(_own_shingles(probed, percent).hint("merge"), F.xxhash64("digest") == F.col("class"), "left").where(F.coalesce("own", F.lit(0)) < keys)
    rows = rows.join(classes.withColumnRenamed("digest", "class_digest").hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("class_digest")), "left_semi")
    survivors = scratch.stage(rows.select("doc_id").distinct(), "survivors")
    scratch.drop(probed)
    own = light.where("doc_id is not null and n > 0").join(classes.hint("merge"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = scratch.stage(own.where("a <> b").distinct(), "links")
    scratch.drop(classes)
    sets = scratch.stage(_sets(docs, survivors, width), "sets")
    scratch.drop(survivors)
    twins = scratch.stage(sets.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twins")
    rows = scratch.stage(_keys(sets, percent).join(to_all(twins).withColumn("twin", F.lit(True)), "doc_id", "left"), "keys")
    pivot = F.max_by("doc_id", F.struct("common", "doc_id")).alias("pivot")
    sums = [F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos")]
    repeated = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max("leads").alias("leads"), F.max("twin").alias("twin"), *sums, pivot).where("rows > 1 and leads")
    repeated = repeated.select("key", "twin", F.when((F.col("rows") == 2) & F.col("twin").isNull(), F.struct("all_n", "all_pos")).alias("two"), "pivot")
    # a key of two sets is one only if they may link; where an id has several sets, positions say nothing
    fits = F.col("two").isNull() | may_link(F.col("n"), F.col("pos"), F.col("two.all_n") - F.col("n"), F.col("two.all_pos") - F.col("pos"), percent)
    pos = F.when(F.col("twin").isNull(), F.col("pos")).otherwise(0).alias("pos")
    shared = scratch.stage(rows.drop("twin").join(repeated.hint("merge"), "key").where(fits).select("doc_id", "n", "key", pos, "pivot", F.col("two").isNotNull().alias("two")), "shared-keys")
    scratch.drop(rows)

    turns = []
    for turn in range(ROUNDS):  # two sets that have most of their keys alone meet once
        k = F.min_by(F.struct("key", "pivot"), F.when(F.lit(turn == 0) | ~F.col("two"), F.xxhash64("key", F.lit(turn)))).alias("k")
        turns.append(shared.groupBy("doc_id").agg(k, F.max("n").alias("n"), F.count("*").alias("all")).where(F.col("k").isNotNull() & (F.col("all") >= LIKELY * key_count(F.col("n"), percent))))
    chosen = reduce(DataFrame.union, turns).distinct().select("doc_id", "n", "k.*")
    chosen = chosen.join(chosen.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).hint("merge"), "key").withColumn("blocks", _blocks(BLOCK, 8))
    pivots = chosen.where("doc_id <> pivot").select("key", "pivot", "blocks").distinct().select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("doc_id"), F.col("pivot").alias("label"), F.lit(True).alias("is_pivot"))
    chosen = chosen.where("doc_id <> pivot").select("key", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int").alias("block"), "doc_id", F.col("doc_id").alias("label"), F.lit(False).alias("is_pivot"))
    chosen = scratch.stage(chosen.union(pivots), "chosen")
    found = scratch.stage(_linking(_with_sets(sets, chosen), percent, "key", "block"), "found")
    scratch.drop(chosen)
    labels = components(found)

    rest = _across(_labelled(shared.groupBy("doc_id", "n", "key").agg(F.min("pos").alias("pos")), labels)).withColumn("blocks", _blocks(4 * BLOCK, 8))
    own_block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rest = rest.withColumn("own", own_block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = scratch.stage(rest.select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "doc_id", "label", "n", "pos"), "rest")
    scratch.drop(shared)
    lists = rest.groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("keys")).join(to_all(twins), "doc_id", "left_anti")
    listed = rest.join(lists.hint("merge"), "doc_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<long>")))
    needed = scratch.stage(_needed(listed, percent).withColumn("is_pivot", F.lit(False)), "needed")
    scratch.drop(rest)
    rest = scratch.stage(_linking(_with_sets(sets, needed), percent, "key", "left", "right"), "found")
    scratch.drop(sets, needed)
    labels = components(found.union(rest).union(links))
    scratch.clear()
    out = light.select("doc_id", F.col("n").alias("n_shingles"))
    return _labelled(out, labels).select("doc_id", "n_shingles", F.col("label").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; rows with a null doc_id stay.
    Of rows that repeat a doc_id with the same text one stays; with other texts all stay or all go."""
    found = join(docs, percent, width).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("rows"))
    flagged = stage(found.where("doc_id <> component or rows > 1"), "flagged")
    left = without_ids(docs, flagged.where("doc_id <> component").select("doc_id"))
    repeated = flagged.where("doc_id = component").select("doc_id")
    if repeated.isEmpty():
        return left
    once = docs.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, for tables of thousands of rows.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2]) WHEN len(words) > 0 THEN [words] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM reach WHERE x = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""
