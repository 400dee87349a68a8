"""Operator 12 against whole-text encodings by the libraries and a plain merge of byte ranges."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import DATA
from zonepack.llm import alignment as A
from zonepack.llm.word_ids import vocabulary_path

BYTES, PIECES = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    """Per text: (a ids, b ids, groups, links) from whole encodings; None without tokens."""
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in visible} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in visible)}

    def b_bytes(i):
        m = re.fullmatch("<0x(..)>", p := b.id_to_piece(i))
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    def of(text):
        if not text:
            return None
        a_ids, b_ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        sides = [[bytes(back[c] for c in a.id_to_token(i)) for i in a_ids], [b_bytes(i) for i in b_ids]]
        if any(b"".join(s) != f" {text}".encode() for s in sides):
            return None
        ends_a, ends_b = (np.cumsum([len(t) for t in s]).tolist() for s in sides)
        cut_a, cut_b, groups = 0, 0, []
        for e in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append((a_ids[cut_a:i], b_ids[cut_b:j]))
            cut_a, cut_b = i, j
        links, i, j = [], 0, 0
        while i < len(a_ids):
            links.append((a_ids[i], b_ids[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        return a_ids, b_ids, groups, links

    return of


def expected(plain, rows):
    found = [(d, plain(t)) for d, t in rows]
    counts = Counter(p for _, f in found if f for p in set(f[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for d, f in found:
        if not f:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a_ids, b_ids, groups, links = f
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((d, len(a_ids), len(b_ids), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def fuzz(n, seed):
    pick = random.Random(seed)
    parts = ["the", "word", "word,", "Größe", "naïve.", "ñ;", "ĳ", "ſ!", "end.", "(so)", "a-b", "x!?", "'", ",", "'s", "'ll", " ", "  ", " ", "\n", "\t", "ß", "é", "é", "漢字", "😀", "　", "\xa0", "\x1c", "\x00", "▁", "12", "3.5", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "!!", "ﬁ", "…", "​", "\r\n", "▁x", "İ"]
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(n)]


def test_chunks_are_encoded_like_whole_texts(plain):
    a, b = A.vocabulary(BYTES), A.vocabulary(PIECES)
    assert not a.whole and not b.whole
    texts = [*fuzz(1500, 3), "x" * 30_000, "la " * 3000, " lead", "trail ", "end.", "a, b; c... d)", "don't isn't's 's", "x'", "  ", "", None, "a  b  c", "\n\n a \n b"]
    got = A.Aligned(pa.array(texts, pa.string()), a, b)
    for ids, ends, side in ((got.a_ids, got.a_ends, 0), (got.b_ids, got.b_ends, 1)):
        for text, begin, end in zip(texts, [0, *ends[:-1].tolist()], ends.tolist()):
            assert ids[begin:end].tolist() == (plain(text) or ([], []))[side], repr(text)


def test_runs_equal_common_ends():
    pick = np.random.default_rng(5)
    for n in (*range(1, 40), 400, 5000):
        for share in (0.05, 0.5, 0.97):
            both = np.sort(pick.choice(np.arange(1, 4 * n + 1), n, replace=False))
            a, b = (np.unique(np.append(both[pick.random(n) < share], [*pick.integers(1, 4 * n, n // 4), 4 * n])) for _ in range(2))
            groups, links = A.diagonal_runs(a, b)
            assert a[groups[0]].tolist() == b[groups[1]].tolist() == np.intersect1d(a, b).tolist()
            begin_a, begin_b = (np.concatenate([[0], e[:-1]]) for e in (a, b))
            assert len(links[0]) == len(np.union1d(a, b)) == len(set(zip(*map(np.ndarray.tolist, links))))
            assert (np.maximum(begin_a[links[0]], begin_b[links[1]]) < np.minimum(a[links[0]], b[links[1]])).all()


@pytest.mark.parametrize("table", [0, 40, 1 << 20])
def test_scores(spark, plain, table):
    """With tables that hold none, some or all of the pairs."""
    pick = random.Random(table)
    texts = fuzz(60, 9) + [" ".join(pick.choice("some common words of texts in a row".split()) for _ in range(30)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "some words"), (3, "again some words"), (3, "again some words"), (500, None)]
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, row int, times string, docs int").repartition(3)
    linked = A.stage(A.align_digests(docs, BYTES, PIECES).withColumn("row", A.F.monotonically_increasing_id()), "linked")
    assert sorted(map(tuple, A.scored(linked, table).select(COLUMNS).collect()), key=str) == expected(plain, rows)


def test_lists_of_a_row(spark, plain):
    text = "Ein naïver Tokenizer trennt Wörter anders"
    row = A.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTES, PIECES).first()
    a_ids, b_ids, groups, links = plain(text)
    cuts = lambda ids, ends: [ids[s:e] for s, e in zip([0, *ends], ends)]
    assert list(zip(cuts(row.a_ids, row.a_ends), cuts(row.b_ids, row.b_ends))) == groups
    assert dict(zip(zip(row.pair_a, row.pair_b), row.times)) == Counter(links)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.scored(A.stage(A.align_digests(empty, BYTES, PIECES).withColumn("row", A.F.monotonically_increasing_id()), "linked")).collect() == []


def test_query(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = A.op12_alignment(spark, DATA).select(COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == expected(plain, rows)
