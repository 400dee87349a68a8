"""Url filters, nearest neighbours, the registered queries and the pipeline."""

import numpy as np
import pytest

from tests.conftest import DATA
from zonepack.llm import ann, entry, url_filter


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, rows, sql_rows, name):
    df = entry.queries()[name](spark, DATA)
    columns, expected = sql_rows(entry.oracle_sql()[name])
    assert sorted(df.columns) == columns and rows(df) == expected


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in entry.queries()) == list(range(1, 11))


def test_odd_urls(spark):
    urls = [None, "abc", "x://", "http://A.COM", "http://com/", "http://u@www.EXAMPLE.com/en/x?y#z", "", "http://free-bets.example.org/", "http://example.com/en/\nx", "http://xexample.net/es/", "http://net/fr/"]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)] + [(5, urls[5], "h", "t"), (None, urls[4], "", "")], "page_id long, url string, host string, token string")
    found = [tuple(r) for r in url_filter.judge(pages).collect()]
    assert sorted(found, key=str) == sorted([
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.com", "", None, "allow"), (4, "com", "/", "com/", "allow"), (None, "com", "/", "com/", "allow"),
        (5, "u@www.example.com", "/en/x", "example.com/en/", "block"), (5, "u@www.example.com", "/en/x", "example.com/en/", "block"), (6, "", "", None, "allow"),
        (7, "free-bets.example.org", "/", None, "block"), (8, "example.com", "/en/\nx", "example.com/en/", "block"), (9, "xexample.net", "/es/", "net/es/", "block"), (10, "net", "/fr/", "net/fr/", "block"),
    ], key=str)
    assert url_filter.judge(pages.where("false")).collect() == []


def test_joined_words_and_rules_without_tokens(spark):
    hosts = ["casinowin.example.net", "freebets.example.org", "my.cheap_pills.org", "ads.track.org", "casinowins.example.net", "bets.free.org"]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate([*hosts, "例え.jp", "x.例え", "例え"])], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages).orderBy("page_id").collect()] == ["block"] * 4 + ["allow"] * 5
    rules = [url_filter.Rule.of_site("block", "例え/"), url_filter.Rule.of_words("block", "a", "b", "c")]
    more = pages.union(spark.createDataFrame([(9 + i, f"http://{h}/") for i, h in enumerate(["abc.org", "a-bc.org", "ab.c.org", "a-b-c.org", "a.c.b.org"])], pages.schema))
    assert [r.page_id for r in url_filter.judge(more, rules).where("verdict = 'block'").orderBy("page_id").collect()] == [7, 8, 9, 10, 11, 12]


def test_rules_on_paths_and_both_ways_of_judging(spark, monkeypatch):
    urls = ["http://a.net/es/x", "http://a.net/especial/", "http://b.org/private/x", "http://b.org/x/private/", "http://www.b.org/", "ftp://c.net/Es/y", "http://net", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    anywhere = url_filter.Rule("block", r"^[^\x00]*\x00/private/", ())
    rules = [*url_filter.SITE_RULES, anywhere, url_filter.Rule.of_site("block", "net/Es/"), url_filter.Rule.of_site("block", "b.org")]
    found = sorted(tuple(r) for r in url_filter.judge(pages, rules).collect())
    assert [(r[3], r[4]) for r in found] == [("net/es/", "block"), (None, "allow"), ("b.org", "block"), ("b.org", "block"), ("b.org", "block"), ("net/Es/", "block"), (None, "allow"), (None, "allow")]
    assert {r[4] for r in url_filter.judge(pages.where("page_id in (2, 3)"), [anywhere]).collect()} == {"block", "allow"}
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", 0)
    assert sorted(tuple(r) for r in url_filter.judge(pages, rules).collect()) == found


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("block", "net/es/", None), ("block", None, ["casino", "win"])], "verdict string, site string, words array<string>")
    assert sorted(url_filter.rules_of(table), key=str) == sorted([url_filter.Rule.of_site("block", "net/es/"), url_filter.Rule.of_words("block", "casino", "win")], key=str)


def brute(vectors, k=5):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], dtype=float)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
        at = int(np.flatnonzero(ids == q)[0])
        score = (x * x[at]).sum(axis=1) / (norm * norm[at])
        order = [j for j in np.lexsort((ids, -score)).tolist() if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    pick = np.random.default_rng(1)
    centres = pick.normal(size=(40, 16))
    more = [(i, (centres[i % 40] + 0.2 * pick.normal(size=16)).tolist()) for i in range(6000)]
    for rows in (vectors, more):
        found = {}
        for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        expected = brute(rows)
        assert found.keys() == expected.keys()
        hits = 0
        for q, own in expected.items():
            got = sorted(found[q])
            assert [g[0] for g in got] == [1, 2, 3, 4, 5]
            true = dict(own)
            hits += len({v for _, v, _ in got} & true.keys())
            assert all(s == pytest.approx(true[v], abs=1e-12) for _, v, s in got if v in true)
        assert hits >= 0.9 * 5 * len(expected)


def test_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(0, same), (1, None), (2, []), (3, [0.0] * 3), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 2.0]), (None, same)]
    rows += [(i, same) for i in range(8, 20)] + [(50, [-1.0, 0.0, 0.0]), (8, same), (0, same)]
    found = [tuple(r)[:4] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in found if q == 0] == [(0, k + 1, 8 + k) for k in range(5)]
    assert [v for q, _, v, _ in found if q == 50] == [0, 8, 9, 10, 11]
    few = ann.search(spark.createDataFrame([(0, same), (1, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_a_vector_that_many_rows_repeat(spark):
    pick = np.random.default_rng(2)
    rows = [(i, [1.0] * 8 if i % 3 else pick.normal(size=8).tolist()) for i in range(3000)]
    found = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [v for _, v in sorted(found[50])] == [1, 2, 4, 5, 7]


def test_an_id_that_many_rows_repeat(spark):
    """Leaves full of rows of one id hold one neighbour: the query goes on until it has five."""
    pick = np.random.default_rng(3)
    rows = [(1, [1.0, 0.001 * i, 0.0]) for i in range(2000)] + [(i, pick.normal(size=3).tolist()) for i in range(2, 1000)] + [(0, [1.0, 0.5, 0.0])]
    found = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in range(0, 1000, 50)} and all([k for k, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in found.values())
    assert sorted(found[0])[0][1] == 1 and sorted(found[0])[0][2] == pytest.approx(1.0)


def test_leaves_grow_with_the_rows(spark, monkeypatch):
    pick = np.random.default_rng(4)
    sizes = []
    for n in (1000, 4000):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pick.normal(size=(n, 8)))], "vec_id long, embedding array<double>")
        monkeypatch.setattr(ann, "LEAF_ROWS", 32)
        sizes.append({r.leaf: r.rows for r in ann.Index(rows, n).sizes.collect()})
    assert 2.5 < len(sizes[1]) / len(sizes[0]) < 6 and all(sum(s.values()) == n for s, n in zip(sizes, (1000, 4000)))
    assert max(map(max, (s.values() for s in sizes))) < 32 * 8


def test_vectors_with_clashing_columns(spark):
    rows = [(i, [1.0, float(i)], 9, "x", 0, [1], 2, 3) for i in range(60)]
    found = ann.search(spark.createDataFrame(rows, "vec_id int, embedding array<float>, leaf int, cell string, rank int, query array<int>, part int, salt int"))
    assert found.columns == ["query_id", "rank", "vec_id", "score", "calibrated_recall"] and found.where("query_id = 0").count() == 5


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, and columns whose names the stages use, go through every stage; so does no row."""
    import corpus_pipeline

    word = "the quick brown fox jumps over a lazy dog near the river bank "
    columns = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, tokens string, label long, digest string, spans string, slots string, bucket int"
    rest = (3, "k", "t", 5, "d", "s", "x", 1)
    texts = [word * 3, word * 3, None, "", "12345", word + "mail me@example.org soon", "a lazy river jumps near the dog over the bank and the brown quick fox " * 100, word * 3]
    rows = [(i, t, "en", None, len(t or ""), *rest) for i, t in enumerate(texts)] + [(0, texts[0], "en", None, 1, *rest), (None, word + "and more", "en", "s", 1, *rest)]
    spark.createDataFrame([(1, "What is the capital of a country that has none?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)):
        some = docs.count()
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, str(tmp_path)).cache()
            assert docs.columns == [c.split()[0] for c in columns.split(", ")], name
        kept = sorted((r.doc_id, r.text) for r in docs.where("doc_id is not null").collect())
        assert [i for i, _ in kept] == ([0, 5, 6] if some else [])  # one row of each text, no row without words
        assert all("@" not in t for _, t in kept) and docs.where("doc_id is null").count() == bool(some)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == (4 if some else 0)


def test_pipeline(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_spans, check_pieces
    from tokenizers import Tokenizer
    from zonepack.llm import decontaminate, packing, pii
    from zonepack.llm.word_ids import vocabulary_path

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    outputs = []
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, DATA).cache()
        assert kept.columns == docs.columns
        outputs.append({r.doc_id: r.text for r in kept.collect()})
    language, single, clean, redacted = outputs
    assert language == {r.doc_id: r.text for r in docs.collect()}  # every document has a known language
    assert set(single) == kept_by_brute_force(list(language.items()), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    leaked = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert set(clean) == set(single) - leaked and leaked
    assert redacted == {i: pii.without(t, pii.finder()(t)) for i, t in clean.items()}
    assert not any(brute_spans(t) for t in redacted.values())
    tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    check_pieces(found.collect(), {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in redacted.items()})


def kept_by_brute_force(docs, width, percent):
    sets = {}
    for i, text in docs:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    best = {i: i for i in sets}
    holders = {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while moved := [(a, b) for a, b in links if best[a] != best[b]]:
        for a, b in moved:
            best[a] = best[b] = min(best[a], best[b])
    return {i for i, low in best.items() if i == low}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_stage_takes_five_words_and_80_percent(spark, seed):
    import corpus_pipeline
    from tests.llm.test_text_operators import near_copies

    words = [f"x{i}" for i in range(100)]  # two changed words: 86 of 106 five-word shingles, 92 of 104 three-word ones
    docs = near_copies(seed) + [(1000, " ".join(words)), (1001, " ".join(w if i not in (30, 60) else "other" for i, w in enumerate(words)))]
    found = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), DATA)
    expected = kept_by_brute_force(docs, 5, 80)
    assert {r.doc_id for r in found.collect()} == expected != kept_by_brute_force(docs, 3, 90)


def test_pipeline_deletes_what_it_has_read(spark):
    import os

    import corpus_pipeline
    from zonepack.llm.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, DATA).count()
    assert {n.rpartition("-")[0] for n in set(os.listdir(folder)) - before} == {"personal_data"}
