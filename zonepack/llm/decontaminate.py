"""Operator 6, benchmark decontamination: template canonicalisation.

A text becomes a sequence of words: lower case, outer punctuation dropped. Numbers (words with a
digit), units (a word of ``UNITS`` right after a number) and names (capitalised words) become typed
placeholders, so a question with other numbers or names has the same template. A capitalised word that
begins a sentence may be a name or not: there are strict templates, in which it is a plain word, and
loose ones, in which it is a name. Windows of ``WINDOW`` template words are hash-joined between
documents and benchmark items (those with fewer plain words than ``LEAST_PLAIN``, loose ones
``LEAST_PLAIN_LOOSE``, say too little and are left out). Windows of a document that lie alike in an
item form an alignment. In it a name or unit of the item stands for what most of its places show; numbers
are free, as equal ones may have different roles. Windows over a place that disagrees don't count, and
where over half of the places of repeated values disagree, only unchanged windows do. An item leaks
into a document when its alignments cover at least ``COVER`` of its strict, its loose or all its windows.

Words that no template stands for make exact windows, without placeholders. An item of fewer than
``WINDOW`` words leaks into each document that has all of them in a row. A run of ``LONG_RUN``
unchanged words is a leak whatever its share of the item.

Documents are read once; a bit table of fixed size, made from all benchmark windows, lets through
those windows that may be in the benchmark, and only these leave the scan. It grows with neither
table. The benchmark side of the join is broadcast while it has at most ``MOST_BROADCAST`` windows,
else both are shuffled and Spark splits skewed keys. Grouping is by (document, item, alignment).

Null and empty texts have no windows. Repeated items: each is reported. Rows with the same doc_id, and those with a null one,
are judged together. Empty tables: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.shared import cuts, documents, stage, without_ids
from zonepack.llm.word_ids import _Kept, strings, take_turn, words_of

WINDOW = 8
LEAST_PLAIN = 5
LEAST_PLAIN_LOOSE = 4
LONG_RUN = 50
COVER = 0.5
MOST_BROADCAST = 200_000
TABLE_BITS = 22
UNITS = frozenset("meter meters metre metres centimeter centimeters centimetre centimetres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces gallon gallons cup cups mm cm dm m km in inch inches ft feet foot yd yard yards mile miles mg g kg t ton tons oz lb lbs ml cl dl l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent percents degree degrees usd eur gbp dollar dollars euro euros cent cents hz khz mhz ghz w kw kwh v a j kj kcal cal pa bar mph kmh".split())
PUNCTUATION = "\"'`.,;:!?()[]{}<>*#$&%|/\\-_=+~^…“”‘’«»—–¿¡"

CAPITAL, NUMBER, UNIT, ENDS, EMPTY = 1, 2, 4, 8, 16
STRICT, LOOSE, EXACT, WHOLE = 1, 2, 4, 8  # kinds of windows; WHOLE * n is a whole item of n words
_PLACEHOLDERS = {"number": np.uint64(0x9E3779B97F4A7C15), "unit": np.uint64(0xC2B2AE3D27D4EB4F), "name": np.uint64(0x165667B19E3779F9)}
_MIX = np.uint64(0x9FB21C651E98DF25)


def _word(chunk: str) -> int:
    """The low five bits say what a word is, the rest is a hash of its lower-case form."""
    core = chunk.strip(PUNCTUATION)
    flags = ENDS if chunk.rstrip("\"')]}”’»*#$&%|")[-1:] in (".", "!", "?", ":") else 0
    if not core:
        return flags | EMPTY
    if any(map(str.isdigit, core)):
        flags |= NUMBER
    elif core[0].isupper() and not (len(core) > 1 and core.isupper()):
        flags |= CAPITAL
    elif core.lower() in UNITS:
        flags |= UNIT
    return xxhash.xxh64_intdigest(core.lower()) & ~31 | flags


_words = _Kept(_word)


def _hashes(code: np.ndarray, n: int, width: int, seed: int = 0) -> np.ndarray:
    hashes = np.full(n, seed, dtype=np.uint64)
    for k in range(width):
        hashes = (hashes ^ code[k : k + n]) * _MIX
        hashes ^= hashes >> np.uint64(29)
    return hashes


class Words:
    """The words of a batch of texts, one text after the other: template codes, slots, and windows of every kind.

    ``strict`` takes a capitalised word that begins a sentence as a plain word, ``loose`` as a name."""

    def __init__(self, column: pa.Array):
        words, index, ends = words_of(column)
        words = strings(words)
        if any(len(w.split()) > 1 for w in words):  # other white space than ASCII has
            words, index, ends = words_of(pa.array([t and " ".join(t.split()) for t in column.to_pylist()], pa.string()))
            words = strings(words)
        coded = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))[index]
        flags = (coded & np.uint64(31)).astype(np.uint8)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        begins = np.ones(len(index), dtype=bool)
        begins[1:] = flags[:-1] & ENDS > 0
        begins[starts[starts < len(index)]] = True
        keep = flags & EMPTY == 0
        if not keep.all():
            index, coded, flags, begins = index[keep], coded[keep], flags[keep], begins[keep]
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.words, self.index, self.plain = words, index, coded >> np.uint64(5)
        self.starts, self.sizes = starts, ends - starts
        self.text = np.repeat(np.arange(len(ends)), self.sizes)
        self.number = flags & NUMBER > 0
        unit = flags & UNIT > 0
        unit[1:] &= self.number[:-1]
        unit[starts[starts < len(index)]] = False
        name = flags & CAPITAL > 0
        code = np.where(self.number, _PLACEHOLDERS["number"], np.where(unit, _PLACEHOLDERS["unit"], self.plain))
        self.strict = np.where(name & ~begins, _PLACEHOLDERS["name"], code)
        self.loose = np.where(name, _PLACEHOLDERS["name"], code)
        self.strict_slot, self.loose_slot = self.number | unit | name & ~begins, self.number | unit | name

    def _inside(self, width: int) -> np.ndarray:
        """Where windows begin that lie in one text."""
        n = len(self.text) - width + 1
        return self.text[:n] == self.text[width - 1 :] if n > 0 else np.zeros(0, dtype=bool)

    def windows(self, width: int = WINDOW) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, positions, hashes): template windows with enough plain words, exact ones where there are none."""
        inside = self._inside(width)
        n = len(inside)
        if not n:
            return []
        usable = []
        for slot, least in ((self.strict_slot, LEAST_PLAIN), (self.loose_slot, LEAST_PLAIN_LOOSE)):
            taken = np.concatenate([[0], np.cumsum(slot)])
            usable.append(inside & (width - (taken[width:] - taken[:n]) >= least))
        out = [(kind, np.flatnonzero(u), _hashes(code, n, width)[u]) for kind, u, code in ((STRICT, usable[0], self.strict), (LOOSE, usable[1], self.loose))]
        rest = np.flatnonzero(inside & ~(usable[0] | usable[1]))
        if len(rest):
            out.append((EXACT, rest, _hashes(self.plain, n, width, EXACT)[rest]))
        return out

    def whole(self, width: int) -> tuple[int, np.ndarray, np.ndarray]:
        """The runs of ``width`` words, for items that are no longer than that."""
        inside = np.flatnonzero(self._inside(width))
        return WHOLE * width, inside, _hashes(self.plain, len(self.plain) - width + 1, width, EXACT + width)[inside] if len(inside) else np.zeros(0, dtype=np.uint64)

    def slots(self, at: int, width: int) -> list[dict]:
        """Offset, value and kind of the slots of a window."""
        return [{"k": k, "value": self.words[self.index[at + k]].strip(PUNCTUATION).lower(), "number": bool(self.number[at + k])} for k in np.flatnonzero(self.loose_slot[at : at + width]).tolist()]

    def rows(self, ids: list[int | None], found: dict[tuple[int, int], int], width: int) -> pa.RecordBatch:
        """Rows of windows {(position, hash): kind}; the positions in them are those inside the text."""
        at = np.array([a for a, _ in found], dtype=np.int64)
        text = self.text[at].tolist()
        kinds = list(found.values())
        slots = [self.slots(a, width) if kind < EXACT else [] for a, kind in zip(at.tolist(), kinds)]
        columns = [pa.array([ids[t] for t in text], pa.int64()), pa.array(at - self.starts[text], pa.int32()), pa.array([h for _, h in found], pa.uint64()).view(pa.int64()), pa.array(kinds, pa.int32()), pa.array(slots, _SLOTS)]
        return pa.RecordBatch.from_arrays(columns, ["id", "at", "hash", "kind", "slots"])


SCHEMA = "id long, at int, hash long, kind int, slots array<struct<k: int, value: string, number: boolean>>"
_SLOTS = pa.list_(pa.struct([("k", pa.int32()), ("value", pa.string()), ("number", pa.bool_())]))


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """All windows of ``items`` (item_id, text). ``kind`` adds up where one hash is of two kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("templates")
        for rows in cuts(batches):
            words = Words(rows.column("text"))
            kinds: dict[tuple[int, int], int] = {}
            for kind, at, hashes in words.windows(width):
                for own in zip(at.tolist(), hashes.tolist()):
                    kinds[own] = kinds.get(own, 0) | kind
            for n in {n for n in words.sizes.tolist() if 0 < n < width}:
                kind, at, hashes = words.whole(n)
                kinds |= {(a, h): kind for a, h in zip(at.tolist(), hashes.tolist()) if words.sizes[words.text[a]] == n}
            yield words.rows(rows.column("id").to_pylist(), kinds, width)

    return items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def window_table(windows_of_items: DataFrame) -> np.ndarray:
    """Which leading ``TABLE_BITS`` bits some window's hash has; made on the executors, or-ed on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        for batch in batches:
            table[batch.column("hash").to_numpy().astype(np.uint64) >> np.uint64(64 - TABLE_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    table = np.zeros(1 << TABLE_BITS >> 3, dtype=np.uint8)
    for row in windows_of_items.select("hash").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        table |= np.frombuffer(row.bits, dtype=np.uint8)
    return np.unpackbits(table).astype(bool)


def leaks(docs: DataFrame, items: DataFrame, cover: float = COVER, width: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, windows, coverage, reparameterised) of every item that leaks into a document."""
    spark = docs.sparkSession
    wanted = stage(item_windows(items, width), "windows")
    table = spark.sparkContext.broadcast(window_table(wanted))

    short = [r.n for r in wanted.where(F.col("kind") >= WHOLE).select((F.col("kind") / WHOLE).cast("int").alias("n")).distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("templates")
        for rows in cuts(batches, most=1 << 19):
            words = Words(rows.column("text"))
            found: dict[tuple[int, int], int] = {}
            for kind, at, hashes in [*words.windows(width), *map(words.whole, short)]:
                hit = table.value[hashes >> np.uint64(64 - TABLE_BITS)]
                found |= dict.fromkeys(zip(at[hit].tolist(), hashes[hit].tolist()), kind)
            if found:
                yield words.rows(rows.column("doc_id").to_pylist(), found, width)

    seen = documents(docs).mapInArrow(run, SCHEMA).select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "hash", F.col("slots").alias("doc_slots"))
    right = wanted.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", "kind", F.col("slots").alias("item_slots"))
    if wanted.count() <= MOST_BROADCAST:
        right = F.broadcast(right)
    # the slots of one side may be plain words of the other: at the start of a sentence, where they are equal
    here, there = F.col("item_slots"), F.col("doc_slots")
    pairs = F.transform(here, lambda a: F.struct((F.col("item_at") + a["k"]).alias("at"), a["value"].alias("a"), F.try_element_at(F.filter(there, lambda b: b["k"] == a["k"])["value"], F.lit(1)).alias("b"), a["number"].alias("number")))
    aligned = (
        seen.join(right, "hash")
        .withColumn("pairs", F.filter(pairs, lambda p: p["b"].isNotNull()))
        .withColumn("same", ~F.exists("pairs", lambda p: p["a"] != p["b"]))
        .groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .agg(F.collect_set(F.struct(F.col("item_at").alias("at"), "kind", "same")).alias("covered"), F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("same"), F.col("pairs"))))).alias("pairs"))
    )
    # a name or unit agrees when its value stands for more than half of what its item value stands for
    bound = F.filter("pairs", lambda p: ~p["number"])
    odd = F.filter("bound", lambda p: 2 * F.size(F.filter("bound", lambda q: (q["a"] == p["a"]) & (q["b"] == p["b"]))) <= F.size(F.filter("bound", lambda q: q["a"] == p["a"])))
    aligned = aligned.withColumn("bound", bound).withColumn("odd", F.transform(odd, lambda p: p["at"]))
    repeated = F.filter("bound", lambda p: F.exists("bound", lambda q: (q["a"] == p["a"]) & (q["at"] != p["at"])))
    agreeing = 2 * F.size("odd") <= F.size(repeated)
    aligned = aligned.withColumn("agreeing", agreeing).withColumn("covered", F.filter("covered", lambda c: c["same"] | F.col("agreeing") & ~F.exists("odd", lambda p: p.between(c["at"], c["at"] + width - 1))))
    exact = F.array_sort(F.array_distinct(F.transform(F.filter("covered", lambda c: c["same"]), lambda c: c["at"])))
    run_of = F.aggregate(
        exact,
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("length"), F.lit(0).alias("best")),
        lambda s, at: F.struct(at.alias("last"), F.when(at == s["last"] + 1, s["length"] + 1).otherwise(1).alias("length"), F.greatest(s["best"], F.when(at == s["last"] + 1, s["length"] + 1).otherwise(1)).alias("best")),
    )["best"]
    aligned = aligned.withColumn("run", run_of)

    def counts(*more) -> list:
        of = lambda kind: F.count_distinct(F.when(F.col("kind").bitwiseAND(kind) > 0, F.col("at")))
        return [F.count_distinct("at").alias("windows"), of(STRICT).alias("strict"), of(LOOSE).alias("loose"), *more]

    sizes = wanted.withColumn("kind", F.when(F.col("kind") < WHOLE, F.col("kind")).otherwise(EXACT)).groupBy(F.col("id").alias("item_id")).agg(*counts())
    sizes = sizes.select("item_id", F.col("windows").alias("n"), F.col("strict").alias("n_strict"), F.col("loose").alias("n_loose"))
    share = lambda found, of: F.coalesce(F.try_divide(F.col(found), F.col(of)), F.lit(0.0))
    return (
        aligned.select("doc_id", "item_id", "run", F.explode("covered").alias("c"))
        .select("doc_id", "item_id", "run", "c.at", F.when(F.col("c.kind") < WHOLE, F.col("c.kind")).otherwise(EXACT).alias("kind"), (~F.col("c.same")).alias("changed"))
        .groupBy("doc_id", "item_id")
        .agg(*counts(F.max("changed").alias("reparameterised"), F.max("run").alias("run")))
        .join(sizes, "item_id")
        .withColumn("coverage", F.greatest(share("windows", "n"), share("strict", "n_strict"), share("loose", "n_loose")))
        .where((F.col("coverage") >= cover) | (F.col("run") + (width - 1) >= LONG_RUN))
        .select("doc_id", "item_id", "windows", "coverage", "reparameterised")
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no item leaks; rows with a null doc_id stay."""
    return without_ids(docs, leaks(docs, items).select("doc_id"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
