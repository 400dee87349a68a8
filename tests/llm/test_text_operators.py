"""Operators on documents: hand-made tables with nulls, empty and long texts, ties, repeats; brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from zonepack.llm import decontaminate, jaccard_join, language_id, packing, pii, quality, token_codec, token_count, word_ids

VOCABULARY = word_ids.vocabulary_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_bytes int, tokens string, keys string, label long"
TEXTS = [
    "The quick brown fox", "", None, " \n\t", "x" * 30_000, "word " * 5_000, "<|endoftext|>a<|startoftext|> b", "naïve Ærø ΣΑΣ 漢字 😀 e\u0301", "a\x1cb \x00c",
    "The quick brown fox", "I'll say 123 times: it's 4 o'clock!", "!!!", "1234",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 11 else None, t, "en" if i % 2 else None, None, None, 7, "x", "y", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def fuzz(n, seed=1):
    pick = random.Random(seed)
    letters = "ab<|>endoftxΣσς İßéé\u0301 \x1c\x1f \u200b漢字がか\u3099'sT'll123½²#@!\n\t\x00😀क्षि"
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(n)]


# 2: token counts


def test_counts_equal_the_library(odd, library):
    found = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(odd, VOCABULARY).collect()]
    expected = [(r.doc_id, len((r.text or "").encode()), len(library(r.text)), len(library(r.text)) > 2048) for r in odd.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_merges_and_ids_on_random_strings(library):
    counter, ids = token_count.MergeCounter(VOCABULARY), word_ids.WordTokenizer(VOCABULARY)
    for text in fuzz(1500):
        expected = library(text)
        assert counter.count(text) == len(expected), repr(text)
        assert np.frombuffer(ids.ids(text), "<u4").tolist() == expected, repr(text)


def test_heap_merging_equals_repeated_scans():
    pick = random.Random(2)
    ranks = {pair: i for i, pair in enumerate([("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "b"), ("ab", "ab"), ("b", "b")])}
    for _ in range(500):
        symbols = [pick.choice("ab") for _ in range(pick.randint(0, 14))]
        slow = list(symbols)
        while pairs := [(ranks[p], i) for i, p in enumerate(zip(slow, slow[1:])) if p in ranks]:
            _, i = min(pairs)
            slow[i : i + 2] = [slow[i] + slow[i + 1]]
        assert token_count.merged_count(symbols, ranks) == len(slow)


# 7: token-id files


def test_files_round_trip(spark, odd, library, tmp_path):
    token_codec.encode(odd, VOCABULARY, str(tmp_path / "f"))
    found = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in token_codec.decode(spark, str(tmp_path / "f")).collect()]
    expected = sorted(((r.doc_id, library(r.text) + [1]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted([f[0::2] for f in found], key=str) == sorted(expected, key=str)
    at = 0
    for doc_id, start, ids in sorted(found, key=lambda x: x[1]):
        assert start == at
        at += len(ids)
    order = [f[0] for f in sorted(found, key=lambda x: x[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_empty_table_makes_empty_files(spark, empty, tmp_path):
    token_codec.encode(empty, VOCABULARY, str(tmp_path / "f"))
    assert token_codec.digests(spark, str(tmp_path / "f")).collect() == []


@pytest.mark.parametrize("n, max_bits", [(1, 4), (2, 4), (3, 2), (40, 6), (300, 9), (1000, 12)])
def test_lengths_are_a_full_limited_code(n, max_bits):
    counts = np.array([1 + 3 ** min(i, 30) for i in range(n)])
    bits = token_codec.limited_lengths(counts, max_bits)
    assert bits.max() <= max_bits and (n < 2 or sum(2.0**-b for b in bits.tolist()) == 1)
    code = token_codec.Code(np.arange(n) * 3, bits)
    pick = np.random.default_rng(n)
    lengths = np.array([1, 7, 2000, 1])
    ids = pick.integers(0, n, lengths.sum()) * 3
    raw, ends, marks, mark_ends = code.encode(ids, lengths, stride=64)
    before = np.repeat(np.concatenate([[0], ends[:-1]]) * 8, np.diff(mark_ends, prepend=0))
    again = code.decode(raw, marks + before, lengths, stride=64)
    assert again.tolist() == ids.tolist()


def test_package_merge_is_optimal():
    import heapq

    counts = np.random.default_rng(3).integers(1, 1000, 200)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1]))
    assert (token_codec.limited_lengths(counts, 30) * counts).sum() == cost


# 9: packing


def test_every_id_lies_in_one_piece(odd, library):
    check_pieces(packing.pack(odd.dropDuplicates(["doc_id"]), VOCABULARY).collect(), {r.doc_id: library(r.text) + [1] for r in odd.collect()})


def check_pieces(rows, expected):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        part = np.array(expected[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(part), len(expected[r.doc_id]))
    assert pieces.keys() == expected.keys()
    for doc_id, own in pieces.items():
        assert_gapless(own, len(expected[doc_id]))
    for own in sequences.values():
        total = sum(n for _, n in own)
        assert_gapless(own, total)
        assert total == 2048 or total & (total - 1) == 0


def assert_gapless(parts, total):
    at = 0
    for start, n in sorted(parts):
        assert start == at and n > 0
        at += n
    assert at == total


def test_costs_are_balanced():
    pick = random.Random(4)
    lengths = [pick.randint(1, 1500) for _ in range(800)]
    cost = defaultdict(float)
    for _, _, n, s, _ in packing.assign(lengths, 2048):
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for s, c in cost.items() if s < sum(lengths) // 2048]
    assert max(full) < 1.35 * min(full)


def test_pack_empty(empty):
    assert packing.pack(empty, VOCABULARY).collect() == []


# 1: languages


def test_languages_held_out(documents):
    rows = {r.doc_id: r.lang for r in documents.collect()}
    found = language_id.predict(documents, language_id.learn(documents)).withColumn("held_out", language_id.held_out()).collect()
    assert len(found) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    own = [r.lang_pred == rows[r.doc_id] for r in found if r.held_out]
    assert sum(own) >= 0.97 * len(own)


def test_code_lengths_equal_a_walk_down_the_trees(documents):
    """The resolved rows against escapes followed one by one, in plain Python."""
    rows = documents.where("doc_id < 40").select("text", "lang").collect()
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r.lang].append(r.text.encode())
    langs = sorted(by_lang)
    counts = []
    for lang in langs:
        run, n = np.unique(np.concatenate([language_id._runs(t) for t in by_lang[lang]]), return_counts=True)
        counts.append((run, n.astype(float)))
    trees = language_id.Trees(langs, counts)
    alphabet = len({b for ts in by_lang.values() for t in ts for b in t}) + 1
    text = rows[0].text.encode()[:300]
    got = trees.code_lengths([text])[0][0]
    for lang, bits in zip(langs, got):
        seen = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
        for t in by_lang[lang]:
            padded = bytes(3) + t
            for i in range(3, len(padded)):
                for k in range(4):
                    seen[k][padded[i - k : i]][padded[i]] += 1
        total, padded = 0.0, bytes(3) + text
        for i in range(3, len(padded)):
            for k in range(3, -1, -1):
                here = seen[k][padded[i - k : i]]
                n, d = sum(here.values()), len(here)
                if padded[i] in here:
                    total += np.log2((n + d) / here[padded[i]])
                    break
                if n:
                    total += np.log2((n + d) / d)
            else:
                total += np.log2(alphabet)
        assert bits == pytest.approx(total, rel=1e-4)


def test_code_lengths_are_those_of_a_code(documents):
    """In every context the lengths of all 256 next bytes leave room for a code, with rare byte values as well."""
    texts = [r.text.encode() for r in documents.where("doc_id < 30").collect()] + [bytes(range(1, 256)) * 2]
    run, n = np.unique(np.concatenate([language_id._runs(t) for t in texts]), return_counts=True)
    for most in (160, 40):
        language_id.MOST_SYMBOLS, before = most, language_id.MOST_SYMBOLS
        try:
            trees = language_id.Trees(["x"], [(run, n.astype(float))])
        finally:
            language_id.MOST_SYMBOLS = before
        bits = trees.bits.reshape(-1, trees.size)[:, trees.symbol]
        room = np.exp2(-bits.astype(np.float64)).sum(axis=1)
        assert room.max() <= 1 + 1e-6 and trees.size <= most + 1
        total, sizes = trees.code_lengths([b"\xfe\xff abc", b""])
        assert sizes.tolist() == [6, 0] and total[1, 0] == 0 and total[0, 0] > 2 * np.log2(255 - most) - 1


def test_foreign_texts_go_at_any_length(spark, documents):
    trees = language_id.learn(documents)
    russian = "Съешь ещё этих мягких французских булок да выпей чаю"
    own = documents.where("length(text) > 400").limit(40).collect()
    clean = [r.text[: r.text.index(" ", cut)] for r in own for cut in (8, 30, 100)] + ["key: sk-93a8Zc0Qx1Lw77 2024-01-01", f"{own[0].text[:60]} 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"]
    foreign = [russian[:22], russian, russian * 20, "漢字仮名交じり文を書く", "नमस्ते दुनिया, आप कैसे हैं"]
    docs = spark.createDataFrame(list(enumerate(clean + foreign + ["漢", "123 456", ""])), "doc_id long, text string")
    kept = {r.doc_id for r in language_id.in_known_language(docs, trees).collect()}
    assert kept == set(range(len(clean))) | {len(clean) + len(foreign)}


def test_language_of_odd_texts(documents, odd, empty):
    trees = language_id.learn(documents)
    found = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(odd, trees).collect()]
    assert len(found) == len(TEXTS) + 1
    assert {i for i, lang, _ in found if lang == "und"} == {1, 2, 3, None, 12}
    assert language_id.learn(empty) is None and language_id.predict(empty, trees).collect() == []
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    kept = language_id.in_known_language(odd, trees)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, None, 12})
    assert language_id.in_known_language(documents, trees).count() == documents.count()


# 10: quality


def test_quality_held_out(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.featurise(documents).cache()
    found = {r.doc_id: r for r in quality.classify(rows, quality.fit(rows, labels)).collect()}
    truth = [(r.quality, found[r.doc_id]) for r in labels.collect() if found[r.doc_id].held_out]
    assert len(found) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert sum(q == r.predicted for q, r in truth) >= 0.9 * len(truth)


def test_quality_of_odd_tables(spark, odd, empty):
    rows = quality.featurise(odd)
    assert rows.where("log_bytes = 0").count() == 2
    one = spark.createDataFrame([(3, 1), (3, 1), (4, None), (99, 0), (None, 1)], "doc_id long, quality int")
    for labels in (one, one.where("false")):
        found = quality.classify(rows, quality.fit(rows, labels)).collect()
        assert len(found) == len(TEXTS) + 1 and {r.score for r in found} <= {0.5, 1.0}
    assert quality.classify(quality.featurise(empty), quality.fit(rows, one)).collect() == []


def test_labels_of_an_id_that_many_rows_have(spark):
    """A third of the labelled rows have one id: the sample takes its share of them, and the same rows count once."""
    n = 6000
    ids = [i for i in range(1, 4 * n) if zlib.crc32(str(i).encode()) % 5]
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, ids[0]).otherwise(F.element_at(F.array(*map(F.lit, ids[1:50])), (F.col("id") % 49 + 1).cast("int"))).alias("doc_id"), *[(F.hash("id", F.lit(f)) / 1e9).alias(f) for f in quality.FEATURES])
    rows = rows.union(rows.where("doc_id = %d" % ids[0]).limit(1).crossJoin(spark.range(1500)).drop("id"))
    labels = spark.createDataFrame([(i, i % 2) for i in ids[:50]], "doc_id long, quality int")
    assert quality.labelled(rows, labels).count() == n
    found = quality.labelled(rows, labels, 600).groupBy("doc_id").count().collect()
    taken, hot = sum(r["count"] for r in found), sum(r["count"] for r in found if r.doc_id == ids[0])
    assert 450 < taken < 750 and 120 < hot < 280
    assert 0 <= quality.fit(rows, labels, 600).score(np.zeros((1, len(quality.FEATURES))))[0] <= 1


def test_tables_and_pairs_learn_an_interaction():
    pick = np.random.default_rng(5)
    x = np.zeros((3000, len(quality.FEATURES)))
    x[:, :3] = pick.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.97


def plain_features(text):
    """The features of one text, byte by byte and word by word."""
    kinds = dict.fromkeys(["upper", "digit", "space", "stop", "symbol", "high", "newline"], 0)
    raw = text.encode()
    for b in raw:
        c = chr(b)
        kind = "high" if b > 127 else "newline" if c == "\n" else "space" if c in " \t\x0b\x0c\r" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "stop" if c in ".," else None if "a" <= c <= "z" else "symbol"
        if kind:
            kinds[kind] += 1
    out = {"log_bytes": np.log(1 + len(raw)), **{k: v / max(1, len(raw)) for k, v in kinds.items()}}
    words, lines = text.split(), text.split("\n")
    rest = ["log_words", "word_bytes", "distinct_words", "top_word", "same_as_before", "odd_end", "short_words", "long_words", "log_lines", "distinct_lines", "words_in_line"]
    if not words:
        return {**out, **dict.fromkeys(rest, 0.0)}
    n = len(words)
    values = [
        np.log(1 + n), sum(map(len, words)) / n, len(set(words)) / n, max(words.count(w) for w in set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(w[-1] in "#$%&*|!<>{}=~^_@+\\/" for w in words) / n, sum(len(w) < 4 for w in words) / n, sum(len(w) > 12 for w in words) / n, np.log(1 + len(lines)), len(set(lines)) / len(lines), n / len(lines),
    ]
    return {**out, **dict(zip(rest, values))}


def test_features_equal_plain_counts(documents):
    texts = [r.text for r in documents.limit(60).collect()] + ["", " \n ", "A1 a1!\n\nÉé é.", "x\x0by\tz, z"]
    got = quality.features(texts)
    for i, text in enumerate(texts):
        expected = plain_features(text)
        assert got[i] == pytest.approx([expected[f] for f in quality.FEATURES], abs=1e-9), repr(text[:60])


def test_scores_equal_plain_look_ups(spark):
    """Bins, table entries and the pairs' cells, one row at a time; bin edges against sorted values."""
    pick = np.random.default_rng(6)
    x = np.round(pick.random((400, len(quality.FEATURES))), 2)
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0.8).astype(float)
    model = quality.AdditiveModel(x, y)
    for f, edges in enumerate(model.edges):
        assert len(edges) < quality.BINS and (np.diff(edges) > 0).all() and edges.min() >= x[:, f].min() and edges.max() <= x[:, f].max()
    for row, score in zip(x[:50], model.score(x[:50])):
        at = [sum(bool(edge <= v) for edge in model.edges[f]) for f, v in enumerate(row)]
        logit = model.intercept + sum(model.tables[f][b] for f, b in enumerate(at)) + sum(t[at[a], at[b]] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_a_step_of_boosting_is_the_best_tree_of_two_leaves():
    pick = np.random.default_rng(7)
    for _ in range(20):
        g, h = pick.normal(size=9), pick.random(9) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        cut = max(range(1, 9), key=lambda c: gain(0, c) + gain(c, 9))
        expected = [g[:cut].sum() / (h[:cut].sum() + 1)] * cut + [g[cut:].sum() / (h[cut:].sum() + 1)] * (9 - cut)
        if gain(0, cut) + gain(cut, 9) > gain(0, 9) + 1e-9:
            assert quality._tree(g, h, 2) == pytest.approx(expected)


# 5: personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(documents):
    pick = random.Random(6)
    texts = [r.text for r in documents.collect()]
    texts += ["".join(pick.choice("aZ09..@+-  ()%_12345\n✓é:/") for _ in range(pick.randint(0, 60))) for _ in range(8000)]
    texts += ["".join(pick.choice("0123456789 -.+") for _ in range(pick.randint(0, 60))) for _ in range(8000)]
    texts += ["1." * 9000, "@" * 5000, "4" * 9000, "+1 " * 3000]
    for text in texts:
        assert [s for s in pii.finder()(text) if s[1] < 4] == brute_spans(text), repr(text[:80])


def test_cues_and_addresses():
    text = 'IBAN: DE89370400440532013000, token = "2abc3ff2ca8f" ftp://me:pw@host.org/x, my account is old'
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.finder()(text) if k > 3] == [("account", "DE89370400440532013000"), ("account", "2abc3ff2ca8f"), ("address", "ftp://me:pw@host.org")]


def test_find_and_redact(spark, odd, empty):
    found = {r.doc_id: r for r in pii.find(odd).collect()}
    assert found[2].base_sha256 == hashlib.sha256(b"").hexdigest() and found[2].spans == "" and found[1].n_email == 0
    docs = spark.createDataFrame([(1, "mail a@b.org now", 16), (2, None, None), (3, "fine", 99)], "doc_id long, text string, n_chars long")
    assert sorted(map(tuple, pii.redact(docs).collect()), key=str) == [(1, "mail [EMAIL] now", 16), (2, None, None), (3, "fine", 99)]
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []


# 3: n-gram join


def brute_components(docs):
    sets = {}
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(best[a], best[b])
            changed |= best[a] != low or best[b] != low
            best[a] = best[b] = low
    return {i: (len(sets[i]), best[i]) for i in sets}


def near_copies(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs, passage = [], [pick.choice(words) for _ in range(60)]
    for base in range(12):
        text = [pick.choice(words) for _ in range(pick.choice([1, 2, 3, 20, 60, 150]))]
        for _ in range(pick.choice([1, 2, 9])):
            copy = list(text)
            for _ in range(pick.choice([0, 0, 1, 2, 3])):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            docs.append(" ".join(copy + (passage if base % 3 == 0 else [])))
    return list(enumerate(docs + ["", None, " \n ", "One", "ONE", "two words", "two  words"]))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = near_copies(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert found == brute_components(docs)


def test_join_of_small_blocks(spark, monkeypatch):
    """Blocks far smaller than the groups: links still meet."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    docs = near_copies(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute_components(docs)


def test_join_of_odd_tables(odd, empty):
    found = jaccard_join.join(odd).collect()
    assert len(found) == len(TEXTS) + 1 and {r.component_id for r in found if r.doc_id is None} == {None}
    assert {r.doc_id: r.component_id for r in found}[9] == 0
    assert jaccard_join.join(empty).collect() == []
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and 9 not in {r.doc_id for r in kept.collect()} and kept.where("doc_id is null").count() == 1


def test_tree_bounds_lose_no_pair():
    from zonepack.llm import signature_tree as S

    pick = np.random.default_rng(8)
    sets = []
    for _ in range(25):
        base = pick.integers(0, 1 << 63, pick.integers(1, 90), dtype=np.uint64)
        for _ in range(4):
            copy = base.copy()
            copy[pick.integers(0, len(copy), max(1, len(copy) // 15))] = pick.integers(0, 1 << 63, dtype=np.uint64)
            sets.append(np.unique(copy))
    sizes = np.array([len(s) for s in sets])
    real = {(j, i) for i in range(len(sets)) for j in range(i) if jaccard_join.linked(sets[i], sets[j], 90)}
    for most_bytes in (1 << 24, 1 << 12):  # a bit a token, and bits that tokens share
        bits, slack = S.signatures(sets, most_bytes)
        assert (most_bytes > 1 << 12) == (not slack.any()) and bits.nbytes <= max(most_bytes, len(sets) * 32)
        asked = []
        S.pairs(sizes, bits, slack, list(range(len(sets))), 90, lambda i, j: asked.append(tuple(sorted((i, j)))))
        assert real <= set(asked) and len(asked) < len(sets) ** 2 / 4
        if not slack.any():
            assert real == set(asked)
        found = S.pairs(sizes, bits, slack, list(range(len(sets))), 90, lambda i, j: jaccard_join.linked(sets[i], sets[j], 90))
        comp = S.Components(list(range(len(sets))))
        for i, j in found:
            comp.union(i, j)
        assert all(comp.find(i) == comp.find(j) for i, j in real) and len(found) < len(sets)


# 6: decontamination

ITEM = "If Jim has 12 apples and gives 4 m of apples to Sue how many apples does Jim have left today in the basket at home"


def test_templates_and_slots(spark):
    items = spark.createDataFrame([(7, ITEM), (8, "short one"), (9, None), (10, "")], "item_id long, text string")
    other = ITEM.replace("Jim", "Tom").replace("12", "5").replace("4 m", "3 kg").replace("Sue", "Mary")
    docs = [(1, f"So we ask. {other}"), (2, other.replace("does Tom", "does Bob")), (3, None), (4, ""), (5, f"Some words. {ITEM} And more."), (6, " ".join(ITEM.split()[:12])), (None, ITEM), (5, ITEM), (11, ITEM.upper())]
    found = {(r.doc_id, r.item_id): (round(r.coverage, 2), r.reparameterised) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert found == {(1, 7): (1.0, True), (5, 7): (1.0, False), (None, 7): (1.0, False)}
    assert {r.doc_id for r in decontaminate.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()} == {None, 2, 3, 4, 6, 11}


def test_leaks_equal_word_runs(spark, documents):
    """The tables hold verbatim passages: plain six-word runs find the same ones."""
    words = lambda t: re.findall(r"\w+", t.lower())
    runs = lambda t: {tuple(w[k : k + 6]) for w in [words(t)] for k in range(len(w) - 5)}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = {r.item_id: runs(r.text) for r in items.collect()}
    expected = {(r.doc_id, i) for r in documents.collect() for own in [runs(r.text)] for i, t in texts.items() if len(own & t) >= 0.5 * len(t)}
    assert expected and {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, items).collect()} == expected


def test_leaks_of_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert decontaminate.leaks(empty, items).collect() == [] and decontaminate.leaks(odd, items.where("false")).collect() == []


def leaked(spark, docs, items):
    docs, items = (spark.createDataFrame(list(enumerate(t)), f"{i} long, text string") for t, i in ((docs, "doc_id"), (items, "item_id")))
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(docs, items).collect()}


def test_reparameterised_questions(spark):
    tom = "Tom has 5 apples. Tom buys 3 more. Tom gives 2 to Ann. How many apples does Tom have now?"
    clock = "The first train to the old harbour leaves at 10:30 in the morning and the second train leaves the same station at 12:30, so how long must a late passenger wait there?"
    paint = "To get this shade you mix 3 parts paint with white spirit, then add 3 parts water and stir the bucket slowly until all of it is smooth."
    changed = [tom.replace("Tom", "Mia").replace("Ann", "Bob"), clock.replace("10:30", "9:15").replace("12:30", "11:45"), paint.replace("3 parts paint", "5 parts paint").replace("3 parts water", "2 parts water")]
    one_slip = tom.replace("Tom", "Mia").replace("does Mia", "does Eve").replace("Ann", "Bob")
    assert leaked(spark, [*changed, one_slip], [tom, clock, paint]) == {(0, 0): True, (1, 1): True, (2, 2): True, (3, 0): True}


def test_a_slot_of_the_item_that_the_document_lacks(spark):
    """A capital that begins the item is a name in its loose template only; in lower case the document has no slot there."""
    item = "Water flows down the long hill every morning and fills the old stone basin below"
    docs = [f"they say {item.replace('Water', 'water')} today", f"He knew. {item}.", "water flows down the long hill"]
    assert leaked(spark, docs, [item]) == {(0, 0): False, (1, 0): False}


def test_items_that_templates_leave_out(spark):
    dense = "Solve 3x + 5 = 20, 4y - 2 = 14, 7z + 1 = 50 and 9w = 81."
    names = "Anna, Boris, Carla, Dmitri, Elena, Fritz, Gustav, Hanna, Igor, Jonas and Karl"
    short = "What is the capital of France?"
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    docs = [f"Task: {t} That was it." for t in (dense, names, short)] + [" ".join(["so", *words[60:160], "on"]), " ".join(["so", *words[60:100], "on"]), "What is the capital of Spain? Paris is that of France."]
    assert leaked(spark, docs, [dense, names, short, " ".join(words)]) == {(0, 0): False, (1, 1): False, (2, 2): False, (3, 3): False}


def test_an_id_that_many_rows_repeat_is_spread(spark, tmp_path, library):
    rows = [(7 if i % 3 else i, f"text {i} of many") for i in range(300)] + [(None, f"nothing {i}") for i in range(150)]
    token_codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, str(tmp_path / "f"))
    found = sorted((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_codec.decode(spark, str(tmp_path / "f")).collect())
    assert [i for _, i, _ in found] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    assert sorted((str(i), ids) for _, i, ids in found) == sorted((str(i), library(t) + [1]) for i, t in rows)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "f/blocks")).selectExpr("bucket", "size(doc_ids) as n").groupBy("bucket").sum("n").toDF("bucket", "count").collect()]
    assert len(sizes) == 4 and max(sizes) < 200


def test_components_of_long_paths(spark, monkeypatch):
    from zonepack.llm import components as C

    monkeypatch.setattr(C, "CHUNK", 7)  # pickled with the function: paths are longer than a chunk
    pick = random.Random(11)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200 + 2 * i, 202 + 2 * i) for i in range(20)] + [(5, 9), (9, 5), (4, 4)]
    pick.shuffle(edges)
    found = {r.node: r.label for r in C.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {200 + 2 * i: 200 for i in range(21)} | {5: 5, 9: 5}


def test_long_texts_in_one_group(spark):
    pick = random.Random(12)
    base = [pick.choice("abcdefghij") + str(pick.randint(0, 4000)) for _ in range(20_000)]
    docs = [(0, " ".join(base))]
    for i in range(1, 7):
        copy = list(base)
        for _ in range(100 if i < 4 else 900):  # three words of 300 shingles changed, and 13 in a hundred
            copy[pick.randrange(len(copy))] = f"new{pick.randint(0, 99)}"
        docs.append((i, " ".join(copy)))
    docs += [(7, " ".join(base[:10_000])), (8, "few words"), (9, "few words")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute_components(docs)
    item = " ".join(base[300:330])
    assert leaked(spark, [docs[0][1], docs[7][1], docs[8][1]], [item]) == {(0, 0): False, (1, 0): False}


def test_templated_pages_make_no_candidates(spark):
    """Pages with four fifths of their words in common: no two link, and the common words make no keys."""
    pick = random.Random(13)
    common = [f"t{i}" for i in range(240)]
    rows = [(i, " ".join([f"p{i}x{pick.randint(0, 10**6)}" for _ in range(60)] + common)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard_join._sets(docs, docs.select("doc_id"), 3)
    keys = jaccard_join._keys(sets, 90).where("leads").groupBy("key").count().where("count > 1")
    assert keys.count() == 0
    assert {r.component_id for r in jaccard_join.join(docs).collect()} == set(range(300))


def reparameterise(pick, words, slots):
    """The words with the slots of each kind filled by a one-to-one choice of values."""
    names = pick.sample("Anna Boris Carla Dmitri Elena Fritz Gustav Hanna Igor Jonas Karla Ludwig Mona Nils".split(), 4)
    numbers = pick.sample(range(2, 900), 4)
    units = pick.sample("kg km liters hours meters miles".split(), 1)
    return " ".join({"name": lambda k: names[k], "number": lambda k: str(numbers[k]), "unit": lambda k: units[0]}[slots[i][0]](slots[i][1]) if i in slots else w for i, w in enumerate(words)), (names, numbers, units)


def test_random_reparameterised_items(spark):
    """Items with other numbers, names and units are found, and those whose names don't stand for one each are not."""
    pick = random.Random(14)
    vocabulary = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "lan ter sim dor vek nup rass quil mont zig".split()]
    items, docs, expected = [], [], {}
    for i in range(25):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(24, 60))]
        slots, at = {}, 3
        while at < len(words) - 3:
            slots[at] = (pick.choice(["name", "number"]), pick.randrange(3))
            if slots[at][0] == "number" and pick.random() < 0.3:
                slots[at + 1] = ("unit", 0)
            at += pick.randint(4, 7)
        item, values = reparameterise(pick, words, slots)
        changed, others = reparameterise(pick, words, slots)
        items.append(item)
        around = [" ".join(pick.choice(vocabulary) for _ in range(20)) for _ in range(2)]
        expected[len(docs), i] = any(values["name number unit".split().index(kind)][k] != others["name number unit".split().index(kind)][k] for kind, k in slots.values())
        docs.append(f"{around[0]} {changed} {around[1]}")
        expected[len(docs), i] = False
        docs.append(f"{around[1]} {item} {around[0]}")
        shuffled = changed.split()
        pick.shuffle(shuffled)
        docs.append(" ".join(shuffled))
    assert leaked(spark, docs, items) == expected


def test_keys_of_two_sets_that_cannot_link_go_nowhere(spark, monkeypatch):
    """Pairs of texts that share a passage, too little for a link: their keys are left before any set is shuffled; ids with
    several texts lose no link."""
    pick = random.Random(17)
    word = lambda: f"w{pick.randint(0, 10**9)}"
    docs = []
    for i in range(0, 60, 2):
        common = [word() for _ in range(84)]
        docs += [(j, " ".join(common + [word() for _ in range(own)])) for j, own in ((i, 4), (i + 1, 18))]
    base = [word() for _ in range(100)]
    docs += [(100, " ".join(base)), (100, " ".join(base[:-1] + ["else"])), (101, " ".join(base[:-3])), (102, " ".join(word() for _ in range(80))), (100, docs[0][1] + " more")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {}
    stage = jaccard_join.Scratch.stage
    monkeypatch.setattr(jaccard_join.Scratch, "stage", lambda self, df, name: found.setdefault(name, stage(self, df, name)) if name == "shared-keys" else stage(self, df, name))
    monkeypatch.setattr(jaccard_join.Scratch, "drop", lambda self, *tables: None)
    monkeypatch.setattr(jaccard_join.Scratch, "clear", lambda self, keep=0: None)
    rows = jaccard_join.join(frame, 80, 3).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i for i in range(1, 60)} | {0: 0, 100: 0, 101: 0, 102: 102}
    assert {r.doc_id for r in found["shared-keys"].collect()} <= {0, 1, 100, 101}, "the others share 82 shingles of 86 and 100"


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_of_all_degrees_equal_brute_force(spark, seed):
    pick = random.Random(seed)
    docs = []
    for i in range(120):
        text = list(pick.choice(docs)[1].split()) if docs and pick.random() < 0.7 else [f"v{pick.randint(0, 60)}" for _ in range(pick.randint(5, 120))]
        for _ in range(pick.randint(0, len(text) // 12)):
            text[pick.randrange(len(text))] = f"v{pick.randint(0, 60)}"
        docs.append((i if pick.random() < 0.97 else pick.randint(0, i), " ".join(text)))
    sets = [(d, set(zip(*[(w := t.split())[k:] for k in range(3)]))) for d, t in docs]
    label = {d: d for d, _ in docs}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    found = jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string"), 80, 3).collect()
    assert {r.doc_id: r.component_id for r in found} == label


def test_counters_tell_lone_shingles_apart_in_a_larger_table(spark):
    """4 Mi shingles, each in one set: with as many counters a third of them would be told apart."""
    import pyarrow as pa

    def sets(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            tokens = [np.sort(np.random.default_rng(i).integers(0, 1 << 64, 4096, dtype=np.uint64)).tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tokens, pa.binary())], ["doc_id", "tokens"])

    table = jaccard_join._rarity(spark.range(0, 1024, 1, 4).mapInArrow(sets, "doc_id long, tokens binary"))
    tokens = np.random.default_rng(7).integers(0, 1 << 64, 4096, dtype=np.uint64)
    assert np.mean(table[jaccard_join._cell(tokens, jaccard_join.RARITY_BITS)] == 0) > 0.7


def test_counters_of_a_task_do_not_run_over(spark):
    """A shingle that 600 sets of one task have stays the commonest."""
    common, token = (np.uint64(5) << np.uint64(60)).tobytes(), (np.uint64(9) << np.uint64(60)).tobytes()
    rows = [(i, bytearray(common)) for i in range(600)] + [(i, bytearray(token)) for i in range(600, 603)]
    table = jaccard_join._rarity(spark.createDataFrame(rows, "doc_id long, tokens binary").coalesce(1))
    at = lambda t: table[jaccard_join._cell(np.frombuffer(t, dtype=np.uint64), jaccard_join.RARITY_BITS)][0]
    assert at(common) == int(4 * np.log2(255)) and at(token) == int(4 * np.log2(3))
