"""Operator 12, cross-tokenizer alignment: diagonal run skipping.

A text is cut into tokens by two vocabularies: A, a byte-level one, gets a space and the text; B, a piece one, puts its
own space mark before the text. Where tokens of both end at one byte, a group ends. Both lists of ends are walked
together: while token i + k of A ends where token j + k of B does, the index shift j - i stays, and such one-to-one
stretches are jumped: blocks of 1, 2, 4, ... ends are compared at once, then the first difference is halved in on.
An irregular group is resolved token by token, which gives the pairs that overlap in it and the new shift.

Tokens are made from chunks, each distinct one once in a worker: a space between two characters that are no
white space begins a chunk, because the pattern of A always begins a piece there, and no piece of B has its
space mark behind another character (both are looked up in the files; else a chunk is a whole text). Symbols at the end
of Latin letters are cut off, as the pattern of A begins a piece there and no piece of B has a symbol behind a letter.

Corpus counts (``scored``): an id pair counts in each document that links it. What a document links (distinct pairs) is
staged; tasks add up pairs before the shuffle. The highest count of each A id is a table no longer than the
vocabulary. The commonest pairs, at most ``TABLE`` of them, go to all tasks as one sorted table, so pairs that
many documents hold are never shuffled with them; links whose pair isn't in it are joined with the rarer
counts by pair, which none of the documents' hot pairs takes part in, and added up by row.

A row is a document, also where rows repeat a doc_id; a null doc_id is kept. Null and empty texts, and those whose tokens do
not spell a space and the text (unknown or altered characters in a vocabulary) have no tokens: zeros and an
empty ``groups_sha256``. Ties of the highest count all count as best. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import weakref
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.shared import cuts, documents, stage
from zonepack.llm.word_ids import ENTRY_BYTES, LONGEST_KEPT, MOST_BYTES, SYMBOLS, _byte_characters, _Kept, _stores, byte_level, strings, take_turn, vocabulary_path

TABLE = 1 << 20
CHUNK = 1 << 22
MARK = "▁"
LATIN_END = "\u0250"


def letters_only(word: str) -> bool:
    """Latin letters up to a place in the code table below which nothing is added any more."""
    return word.isalpha() and (word.isascii() or max(word) < LATIN_END)


class Generations:
    """Values by word of which a worker keeps the last ones, like ``_Kept``, for all words of a batch at once."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int = MOST_BYTES):
        self.make, self.most = make, most
        self.clear()
        _stores.append(weakref.ref(self))

    def clear(self) -> None:
        self.new, self.old, self.held = {}, {}, 0

    def of(self, words: list[str]) -> list[bytes]:
        """The values of distinct words; those that aren't there are made together."""
        new, old = self.new, self.old
        found = [new.get(w) or old.get(w) for w in words]
        missing = [i for i, v in enumerate(found) if not v]
        for i, v in zip(missing, self.make([words[i] for i in missing])):
            found[i] = v
        added = {w: v for w, v in zip(words, found) if w not in new and len(w) <= LONGEST_KEPT}
        new.update(added)
        self.held += len(added) * ENTRY_BYTES + sum(map(len, added)) + sum(map(len, added.values()))
        if self.held > self.most:
            self.new, self.old, self.held = {}, new, 0
        return found


class Vocabulary:
    """Ids of chunks. ``pieces`` has the bytes of each id; ``whole`` says that texts can't be cut into chunks, ``splits`` that
    symbols behind letters at the end of a chunk are tokens of their own."""

    pieces: list[bytes]
    whole: bool
    splits: bool

    def ids_of(self, chunks: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def ids_of_tail(self, tail: str) -> list[int]:
        raise NotImplementedError

    def _made(self, chunks: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk; one byte more where they don't spell a space and the chunk."""
        ids = self.ids_of(chunks)
        spelled = [b" " + c.encode() for c in chunks]
        sizes = [len(i) for i in ids]
        flat = [x for i in ids for x in i]
        lengths = np.diff(np.concatenate([[0], np.cumsum(self.lengths[flat] if flat else [])])[np.cumsum(sizes)], prepend=0) if ids else []
        if b"".join([self.pieces[x] for x in flat]) == b"".join(spelled) and list(map(len, spelled)) == list(lengths):
            return [array("I", i).tobytes() for i in ids]
        return [array("I", i).tobytes() + (b"" if b"".join([self.pieces[x] for x in i]) == t else b"!") for i, t in zip(ids, spelled)]

    @cached_property
    def kept(self) -> Generations:
        return Generations(self._made)

    @cached_property
    def tails(self) -> _Kept:
        return _Kept(lambda tail: array("I", self.ids_of_tail(tail)).tobytes(), 1 << 20)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces], dtype=np.int64)

    def encode(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where those of each text end, and which texts have a chunk that isn't spelled."""
        found = self.kept.of(chunks.cores if self.splits else chunks.distinct)
        if self.splits:
            tails = list(map(self.tails.__getitem__, chunks.tails))
            found = [found[c] if t < 0 else found[c] + tails[t] for c, t in zip(chunks.core_of, chunks.tail_of)]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        odd = lengths & 3 > 0
        ids = np.frombuffer(b"".join([f[: len(f) & ~3] for f in found] if odd.any() else found), dtype="<u4")
        sizes = lengths >> 2
        starts, each = np.cumsum(sizes) - sizes, sizes[chunks.index]
        ends = np.cumsum(each)
        out = ids[np.repeat(starts[chunks.index] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        misspelled = np.concatenate([[0], np.cumsum(odd[chunks.index])])[chunks.ends]
        return out, np.concatenate([[0], ends])[chunks.ends], np.diff(misspelled, prepend=0) > 0


class ByteVocabulary(Vocabulary):
    """A tokenizers file with a byte-level alphabet; the text is encoded behind a space."""

    splits = True

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        splitter = file.get("pre_tokenizer") or {}
        self.whole = bool(file.get("normalizer")) or splitter.get("type") != "ByteLevel" or not splitter.get("use_regex") or splitter.get("add_prefix_space")
        back = {chr(c): b for b, c in {**{b: b for b in range(256)}, **_byte_characters()}.items()}
        self.space = next(c for c, b in back.items() if b == ord(" ") and c != " ")
        names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.pieces = [bytes(back[c] for c in names[i]) if i in names and set(names[i]) <= back.keys() else b"" for i in range(max(names) + 1)]

    def ids_of(self, chunks: list[str]) -> list[list[int]]:
        """Letters behind a space are one piece of the pattern: merged at once."""
        merged, encode, space = self.library.model.tokenize, self.library.encode, self.space
        return [[t.id for t in merged(space + byte_level(c))] if letters_only(c) and not self.whole else encode(f" {c}", add_special_tokens=False).ids for c in chunks]

    def ids_of_tail(self, tail: str) -> list[int]:
        return self.library.encode(tail, add_special_tokens=False).ids


class PieceVocabulary(Vocabulary):
    """A sentencepiece model, which puts a space mark before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", n) for n in names]
        self.pieces = [bytes([int(m[1], 16)]) if m else n.replace(MARK, " ").encode() for m, n in zip(byte, names)]
        self.whole = any(MARK in n.lstrip(MARK) for n in names) or "".join(self.library.encode("a  b", out_type=str)) != f"{MARK}a{MARK * 2}b"
        mixed = re.compile(rf"[^\W\d_][{re.escape(SYMBOLS)}]")
        own = [n for i, n in enumerate(names) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.splits = not any(mixed.search(n) for n in own) and self.library.encode("a") == [self.library.piece_to_id(f"{MARK}a")]

    def ids_of(self, chunks: list[str]) -> list[list[int]]:
        return self.library.encode(chunks, num_threads=1)

    def ids_of_tail(self, tail: str) -> list[int]:
        return self.library.encode(f"a{tail}")[1:]


def vocabulary(path: str) -> Vocabulary:
    return ByteVocabulary(path) if path.endswith(".json") else PieceVocabulary(path)


class Chunks:
    """The distinct chunks of a column of texts, for each chunk in turn which of them it is (``index``), and where the
    chunks of each text end. Chunks joined by single spaces are the text. A distinct chunk is the core ``core_of`` and the
    tail ``tail_of`` (-1: none): Latin letters and the symbols after them, or all of it."""

    def __init__(self, texts: pa.Array, whole: bool):
        if whole:
            coded = texts.dictionary_encode()
            self.distinct, self.index, self.ends = strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64), np.arange(1, len(texts) + 1)
        else:
            self.distinct, self.index, self.ends = self._cut(texts)
        cores: dict[str, int] = {}
        tails: dict[str, int] = {}
        self.core_of, self.tail_of = [], []
        for chunk in self.distinct:
            core = chunk.rstrip(SYMBOLS)
            if len(core) == len(chunk) or whole or not letters_only(core):
                self.core_of.append(cores.setdefault(chunk, len(cores)))
                self.tail_of.append(-1)
            else:
                self.core_of.append(cores.setdefault(core, len(cores)))
                self.tail_of.append(tails.setdefault(chunk[len(core) :], len(tails)))
        self.cores, self.tails = list(cores), list(tails)

    @staticmethod
    def _cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        parts, index = strings(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
        head, tail = np.zeros(len(parts), dtype=bool), np.zeros(len(parts), dtype=bool)
        for i, p in enumerate(parts):
            if not p or len(p.strip()) < len(p) or MARK in p:  # few have white space at an end
                head[i], tail[i] = (not p or c.isspace() or c == MARK for c in (p[:1], p[-1:]))
        joined = np.zeros(len(index), dtype=bool)  # to the part before
        joined[1:] = tail[index[:-1]] | head[index[1:]]
        joined[np.concatenate([[0], ends[:-1]])[: len(ends)]] = False
        if not joined.any():
            return parts, index, ends
        first = np.flatnonzero(~joined)
        sizes = np.diff(np.append(first, len(index)))
        out = index[first]
        new: dict[str, int] = {}
        for g in np.flatnonzero(sizes > 1).tolist():
            chunk = " ".join([parts[i] for i in index[first[g] : first[g] + sizes[g]].tolist()])
            out[g] = new.setdefault(chunk, len(parts) + len(new))
        return [*parts, *new], out, np.cumsum(~joined)[ends - 1]


def diagonal_runs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of two lists of ends with the same last end: (last token of A, of B) of each group, and (token of A, of B) of
    each pair that overlaps, both in order."""
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.astype("<u8").tobytes(), ends_b.astype("<u8").tobytes()
    n_a, n_b = len(a), len(b)
    runs: list[int] = []  # i, j, k: tokens i + t and j + t, t < k, end together and begin together
    last: list[int] = []  # i, j: last tokens of an irregular group
    over: list[int] = []  # i, j: tokens that overlap in one
    i = j = 0
    while i < n_a:
        x, y = a[i], b[j]
        if x == y:
            k, step, most = 1, 1, min(n_a - i, n_b - j)
            while k < most:  # twice as far each time
                step = min(step, most - k)
                at_a, at_b = (i + k) << 3, (j + k) << 3
                if raw_a[at_a : at_a + (step << 3)] != raw_b[at_b : at_b + (step << 3)]:
                    while step > 1:  # the first difference lies in this block
                        step >>= 1
                        at_a, at_b = (i + k) << 3, (j + k) << 3
                        if raw_a[at_a : at_a + (step << 3)] == raw_b[at_b : at_b + (step << 3)]:
                            k += step
                    while k < most and a[i + k] == b[j + k]:
                        k += 1
                    break
                k += step
                step <<= 1
            runs += (i, j, k)
            i += k
            j += k
            continue
        while x != y:
            over += (i, j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        over += (i, j)
        last += (i, j)
        i += 1
        j += 1
    i, j, k = np.array(runs, dtype=np.int64).reshape(-1, 3).T
    more = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    straight = np.repeat(i, k) + more, np.repeat(j, k) + more
    odd, pairs = (np.array(v, dtype=np.int64).reshape(-1, 2).T for v in (last, over))
    # both numbers of groups and pairs only grow, so each sorted by itself they belong together
    groups, links = (tuple(np.sort(np.concatenate([s, o])) for s, o in zip(straight, other)) for other in (odd, pairs))
    return groups, links


class Aligned:
    """The tokens of a batch of texts in both vocabularies, their groups and links.

    ``a_ids`` and ``b_ids`` lie one text after the other and end at ``a_ends`` and ``b_ends``; ``last_a`` and ``last_b`` are the
    last tokens of all groups, ``link_a`` and ``link_b`` the tokens of all links, numbered through the batch."""

    def __init__(self, column: pa.Array, a: Vocabulary, b: Vocabulary):
        texts = column.fill_null("")
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        chunks = Chunks(texts, a.whole or b.whole)
        sides = [v.encode(chunks) for v in (a, b)]
        good = full.copy()
        for row in np.flatnonzero(full & (sides[0][2] | sides[1][2])).tolist():
            whole = b" " + texts[row].as_py().encode()
            good[row] = all(b"".join([v.pieces[i] for i in ids[ends[row - 1] if row else 0 : ends[row]].tolist()]) == whole for v, (ids, ends, _) in zip((a, b), sides))
        (self.a_ids, self.a_ends), (self.b_ids, self.b_ends) = (self._without(ids, ends, good) for ids, ends, _ in sides)
        # a text has the same bytes on both sides, so its end is a common one: the batch is walked in one go
        (self.last_a, self.last_b), (self.link_a, self.link_b) = diagonal_runs(np.cumsum(a.lengths[self.a_ids]), np.cumsum(b.lengths[self.b_ids]))
        self.groups, self.links = (np.diff(np.searchsorted(v, self.a_ends), prepend=0) for v in (self.last_a, self.link_a))

    @staticmethod
    def _without(ids: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(ends, prepend=0)
        return (ids, ends) if good.all() else (ids[np.repeat(good, sizes)], np.cumsum(sizes * good))


_open: dict[str, Vocabulary] = {}


def _opened(path: str) -> Vocabulary:
    if path not in _open:
        _open[path] = vocabulary(path)
    return _open[path]


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, pair_a array<int>, pair_b array<int>, times array<int>"
LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_a array<int>, pair_b array<int>, times array<int>"


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    take_turn("alignment")
    a, b = _opened(a_path), _opened(b_path)
    span = len(b.pieces)
    for rows in cuts(batches):
        found = Aligned(rows.column("text"), a, b)
        group_ends = np.cumsum(found.groups)
        ends_a = found.last_a + 1 - np.repeat(found.a_ends - np.diff(found.a_ends, prepend=0), found.groups)
        ends_b = found.last_b + 1 - np.repeat(found.b_ends - np.diff(found.b_ends, prepend=0), found.groups)
        text = np.repeat(np.arange(rows.num_rows), found.links)
        keys, times = np.unique((text * len(a.pieces) + found.a_ids[found.link_a]) * span + found.b_ids[found.link_b], return_counts=True)
        pair_ends = np.searchsorted(keys, np.arange(1, rows.num_rows + 1) * len(a.pieces) * span)
        lists = [(found.a_ids, found.a_ends), (found.b_ids, found.b_ends), (ends_a, group_ends), (ends_b, group_ends)]
        lists += [(keys // span % len(a.pieces), pair_ends), (keys % span, pair_ends), (times, pair_ends)]
        columns = [rows.column("doc_id"), *[pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(v.astype(np.int32))) for v, ends in lists]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "pair_a", "pair_b", "times"])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends, pair_a, pair_b, times) of every row: the ids of both vocabularies, how many tokens
    of each side the groups end after, and the distinct id pairs whose tokens overlap, with the number of such overlaps."""
    return documents(docs).mapInArrow(lambda batches: _aligned(batches, a_path, b_path), ALIGNED)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists one after the other, and where each list ends."""
    return column.flatten().to_numpy(), column.offsets.to_numpy()[1:].astype(np.int64) - column.offsets[0].as_py()


_spelled: list[np.ndarray] = [np.zeros(0, dtype=object)]


def _digested(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of ``align`` with numbers of tokens, groups and links, and a digest of the groups in place of ids and groups."""
    (a, a_ends), (b, b_ends), (g_a, g_ends), (g_b, _) = (_flat(rows.column(c)) for c in ("a_ids", "b_ids", "a_ends", "b_ends"))
    times, pair_ends = _flat(rows.column("times"))
    if len(a) and (most := int(max(a.max(), b.max()))) * 3 + 3 > len(_spelled[0]):
        _spelled[0] = np.array([f"{i}{s}" for i in range(most + 1) for s in ",|;"], dtype=object)
    groups = np.diff(g_ends, prepend=0)
    g_a = g_a + np.repeat(a_ends - np.diff(a_ends, prepend=0), groups)  # through the batch
    g_b = g_b + np.repeat(b_ends - np.diff(b_ends, prepend=0), groups)
    mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    mark_a[g_a - 1], mark_b[g_b - 1] = 1, 2
    # a token stands behind all tokens of the other side in the groups before; those of B behind those of A in their own too
    sizes_a, sizes_b = np.diff(g_a, prepend=0), np.diff(g_b, prepend=0)
    out = np.empty(len(a) + len(b), dtype=object)
    out[np.arange(len(a)) + np.repeat(g_b - sizes_b, sizes_a)] = _spelled[0][a.astype(np.int64) * 3 + mark_a]
    out[np.arange(len(b)) + np.repeat(g_a, sizes_b)] = _spelled[0][b.astype(np.int64) * 3 + mark_b]
    ends = (a_ends + b_ends).tolist()
    texts = ["".join(out[s:e].tolist())[:-1] for s, e in zip([0, *ends[:-1]], ends)]
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
    links = np.diff(np.concatenate([[0], np.cumsum(times, dtype=np.int64)])[pair_ends], prepend=0)
    numbers = [np.diff(e, prepend=0) for e in (a_ends, b_ends, g_ends)]
    columns = [rows.column("doc_id"), *[pa.array(n, pa.int64()) for n in (*numbers, links)], pa.array(digests, pa.string()), *[rows.column(c) for c in ("pair_a", "pair_b", "times")]]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair_a", "pair_b", "times"])


def align_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pair_a, pair_b, times): what a row of ``align`` comes to, made where it is."""
    return documents(docs).mapInArrow(lambda batches: map(_digested, _aligned(batches, a_path, b_path)), LINKED)


def _some(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Row slices with about ``most`` pairs, one row at least."""
    for batch in batches:
        ends = _flat(batch.column("times"))[1]
        begin = 0
        while begin < batch.num_rows:
            end = max(begin, int(np.searchsorted(ends, (int(ends[begin - 1]) if begin else 0) + most))) + 1
            yield batch.slice(begin, end - begin)
            begin = end


def pair_counts(linked: DataFrame, most: int = CHUNK) -> DataFrame:
    """(a, b, docs): how many rows of ``linked`` (pair_a, pair_b: distinct in a row) have each id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def added() -> pa.RecordBatch:
            keys, docs = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(docs, pa.int64())], ["pair", "docs"])

        for rows in _some(batches):
            held.append(_flat(rows.column("pair_a"))[0].astype(np.int64) << 32 | _flat(rows.column("pair_b"))[0])
            n += len(held[-1])
            if n >= most:
                yield added()
                held, n = [], 0
        if held:
            yield added()

    sums = linked.select("pair_a", "pair_b", "times").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    return sums.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "docs")


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The commonest pairs, at most ``most``, sorted, with their counts; all that are in 2^level documents or more."""
    power = F.floor(F.log2(F.col("docs").cast("double"))).cast("int")
    classes = {r.level: r["count"] for r in counts.groupBy(power.alias("level")).count().collect()}  # 64 rows at most
    level = total = 0
    for k in sorted(classes, reverse=True):
        total += classes[k]
        if total > most:
            level = k + 1
            break
    found = counts.where(power >= level).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "docs").toArrow()
    pairs, docs = (found.column(c).to_numpy() for c in ("pair", "docs"))
    order = np.argsort(pairs)
    return pairs[order], docs[order], level


def scored(linked: DataFrame, table: int = TABLE) -> DataFrame:
    """``linked`` (staged rows of ``align_digests``, with a number ``row`` each) with n_best and count_sum in place of the pairs: of the links, how many
    have a pair that is the commonest of its A id, and the sum of the pairs' document counts."""
    spark = linked.sparkSession
    counts = stage(pair_counts(linked), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))  # a row for each id of the vocabulary
    best = highest.toArrow()
    top = np.zeros(int(pc.max(best.column("a")).as_py()) + 1 if best.num_rows else 1, dtype=np.int64)
    top[best.column("a").to_numpy()] = best.column("highest").to_numpy()
    pairs, docs, level = _common(counts, table)
    shared = spark.sparkContext.broadcast((pairs, docs, top))
    numbers = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, top = shared.value
        for rows in _some(batches):
            (a, ends), (b, _), (times, _) = (_flat(rows.column(c)) for c in ("pair_a", "pair_b", "times"))
            pair = a.astype(np.int64) << 32 | b
            at = np.searchsorted(pairs, pair)
            at[at == len(pairs)] = 0
            known = pairs[at] == pair if len(pairs) else np.zeros(len(pair), dtype=bool)
            count = np.where(known, docs[at], 0) if len(pairs) else np.zeros(len(pair), dtype=np.int64)
            by_row = lambda v: pa.array(np.diff(np.concatenate([[0], np.cumsum(v)])[ends], prepend=0), pa.int64())
            left_ends = np.concatenate([[0], np.cumsum(~known)])[ends]
            left = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], left_ends]), pa.int32()), pa.array(v[~known].astype(np.int32))) for v in (a, b, times)]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("row", *numbers)], by_row(times * (known & (count == top[a]))), by_row(times * count), *left], ["row", *numbers, "n_best", "count_sum", "pair_a", "pair_b", "times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pair_a array<int>, pair_b array<int>, times array<int>"
    out = linked.mapInArrow(run, schema)
    if level:  # some pairs are not in the table
        out = stage(out, "scored", compression="zstd")
        rest = out.select("row", F.explode(F.arrays_zip("pair_a", "pair_b", "times")).alias("link")).select("row", F.col("link.pair_a").alias("a"), F.col("link.pair_b").alias("b"), F.col("link.times").alias("times"))
        rare = counts.where(F.col("docs") < 2**level).join(F.broadcast(highest), "a").select("a", "b", "docs", (F.col("docs") == F.col("highest")).alias("is_best"))
        more = rest.join(rare, ["a", "b"]).groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select(*numbers[:-1], "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = align_digests(docs, vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    linked = stage(found.withColumn("row", F.monotonically_increasing_id()), "linked", compression="zstd")
    return scored(linked)
