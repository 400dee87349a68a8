"""Operator 4, URL filters: pattern rules indexed by their rarest literal token.

A rule is a verdict, a regular expression over ``host + path`` (one that Python and Java read alike), sets of
literal tokens, one of which every url it fits must hold in full, and a weight. Token counts over all urls of the
table say which token of a set is the rarest; the rule is filed under that one, once a set. Tokens come from the
host and from what the path says in full: ``net/es/`` is filed under ``es`` where that is rarer. A set without
tokens is filed under the empty token, which every url has. A url's distinct tokens fetch the rules filed under
them, and only those run their expressions. Among the rules that fit, site rules (``com/``, ``example.com/en/``)
come before the spam patterns, and the longest wins, then the last by text.

The rules are a parameter; ``rules_of`` reads them from a table. While they are at most ``MOST_BROADCAST`` the
index goes to all tasks and urls are judged where they are read, without a shuffle; beyond that the index is
joined by token. A url's tokens are distinct and its rows stay apart, so a token that a third of all urls share
makes no group.

Null url or none with ``://``: host and path are empty, no site rule fits, the verdict is allow.
Repeated pages: one row each. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.llm.word_ids import take_turn

MOST_BROADCAST = 100_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``weight`` ranks rules that fit the same url; ``site`` is the rule's own text, null for a pattern."""

    verdict: str
    pattern: str
    tokens: tuple[tuple[str, ...], ...]
    site: str | None = None

    @staticmethod
    def of_site(verdict: str, site: str) -> Rule:
        host, slash, path = site.partition("/")
        literal = tuple(dict.fromkeys(re.findall(TOKEN, host) + re.findall(rf"{TOKEN}(?=[^a-z0-9])", path)))
        return Rule(verdict, rf"^([^\x00]*\.)?{re.escape(host)}\x00{re.escape(slash + path)}", (literal,), site)

    @staticmethod
    def of_words(verdict: str, *words: str) -> Rule:
        """Words that stand side by side in the host, joined or with a separator."""
        spellings = [words[0]]
        for word in words[1:]:
            spellings = [s + gap + word for s in spellings for gap in ("-", "")]
        literals = tuple(tuple(dict.fromkeys(re.findall(TOKEN, s))) for s in spellings)
        return Rule(verdict, rf"^[^\x00]*(?<![a-z0-9]){'[-._]?'.join(words)}(?![a-z0-9])[^\x00]*\x00", literals)


    @property
    def rank(self) -> tuple[bool, int, str]:
        return self.site is not None, len(self.site or self.pattern), self.site or self.pattern


SITE_RULES = [
    Rule.of_site("allow", "com/"),
    Rule.of_site("block", "example.com/en/"),
    Rule.of_site("allow", "www.example.com/en/"),
    Rule.of_site("block", "net/es/"),
    Rule.of_site("block", "net/fr/"),
]
SPAM_RULES = [Rule.of_words("block", "casino", "win"), Rule.of_words("block", "free", "bets"), Rule.of_words("block", "cheap", "pills"), Rule.of_words("block", "ads", "track")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from a table (verdict, site, words): a site such as ``example.com/en/``, or else an array of words."""
    rows = table.select("verdict", "site", "words").distinct().toLocalIterator()
    return [Rule.of_site(r.verdict, r.site) if r.site is not None else Rule.of_words(r.verdict, *r.words) for r in rows]


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    rules = SITE_RULES + SPAM_RULES if rules is None else rules
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return (_where_they_are if len(rules) <= MOST_BROADCAST else _by_join)(urls, rules)


def url_tokens() -> Column:
    found = [F.regexp_extract_all(c, F.lit(f"({TOKEN})"), 1) for c in ("host", "path")]
    return F.array_union(*found)


def _where_they_are(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    spark = urls.sparkSession
    sets = [(n, own) for n, r in enumerate(rules) for own in r.tokens or ((),)]
    wanted = spark.createDataFrame(sorted({(t,) for _, own in sets for t in own}), "token string")
    seen = urls.select(F.explode(url_tokens()).alias("token")).join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("seen"))
    counts = {r["token"]: r["seen"] for r in seen.collect()}  # a row a token of the rules at most
    index: dict[str, list[int]] = {}
    for n, own in sets:
        index.setdefault(min(own, key=lambda t: (counts.get(t, 0), t), default=""), []).append(n)
    shared = spark.sparkContext.broadcast((index, [(r.rank, r.pattern, r.site, r.verdict) for r in rules]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("urls")
        index, rules = shared.value
        fits = [re.compile(pattern).search for _, pattern, _, _ in rules]
        always, tokens_of = index.get("", []), re.compile(TOKEN).findall
        for batch in batches:
            site, verdict = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                fetched = {n for t in {*tokens_of(host), *tokens_of(path)} if t in index for n in index[t]}.union(always)
                best = max((n for n in fetched if fits[n](f"{host}\0{path}")), key=lambda n: rules[n][0], default=None)
                site.append(None if best is None else rules[best][2])
                verdict.append("allow" if best is None else rules[best][3])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(site, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _by_join(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(n, k, r.verdict, r.pattern, list(own) or [""], r.site) for n, r in enumerate(rules) for k, own in enumerate(r.tokens or ((),))],
        "n long, k long, rule_verdict string, pattern string, tokens array<string>, site string",
    )
    wanted = table.select("n", "k", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(url_tokens()).alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    rarest = wanted.join(seen, "token", "left").groupBy("n", "k").agg(F.min_by("token", F.struct(F.coalesce("seen", F.lit(0)), "token")).alias("token"))
    index = table.join(rarest, ["n", "k"]).select("token", "rule_verdict", "pattern", "site")
    rows = urls.withColumn("key", F.struct(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part")))
    candidates = rows.withColumn("token", F.explode(F.array_append(url_tokens(), ""))).join(index, "token", "left")
    fits = F.expr("concat(host, char(0), path) rlike pattern")
    rank = F.when(fits, F.struct(F.col("site").isNotNull().cast("int").alias("of_site"), F.length(F.coalesce("site", "pattern")).alias("length"), F.coalesce("site", "pattern").alias("text"), "site", "rule_verdict"))
    best = candidates.groupBy("key", "page_id", "host", "path").agg(F.max(rank).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.site").alias("rule"), F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), url AS (
  SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1, 's')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM split
), rules AS (
  SELECT * FROM (VALUES ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'), ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')) r(rule_verdict, rule_host, rule_path, rule)
), fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(rule_verdict, length(rule)) AS rule_verdict
  FROM url JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN regexp_matches(host, '(^|[^a-z0-9])(casino[-._]?win|free[-._]?bets|cheap[-._]?pills|ads[-._]?track)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM url LEFT JOIN fit USING (page_id)
"""
