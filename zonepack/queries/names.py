"""Names, paths, query texts, collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepack.functions import text as T
from zonepack.operators import reports, strata
from zonepack.queries.registry import Tables, query

#: The same rules in DuckDB's regular expressions, for one column x.
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[\x00-\x1f\x7f<>:"/\\|?*]', '', 'g'), '[\s\x85\p{{Z}}]+', ' ', 'g'), '^ +', ''), '[. ]+$', '')"""
_RESERVED = "regexp_matches(upper(rtrim(split_part({x}, '.', 1))), '^(CON|PRN|AUX|NUL|(COM|LPT)[0-9¹²³])$')"


def _sanitized(source: str, x: str, rest: str) -> str:
    return f"""WITH a AS (SELECT *, {_CLEAN.format(x=x)} AS c0 FROM {source}),
b AS (SELECT *, CASE WHEN {_RESERVED.format(x='c0')} THEN '_' || c0 ELSE c0 END AS c1 FROM a),
named AS (SELECT *, CASE WHEN regexp_replace(substr(c1, 1, 255), '[. ]+$', '') = '' THEN '_' ELSE regexp_replace(substr(c1, 1, 255), '[. ]+$', '') END AS name FROM b)
{rest}"""


def turns(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", "text")


def url_path(url: str = "url") -> F.Column:
    """What follows the scheme, without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), "[?#].*$", "")


URL_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(_sanitized("conversations", "text", "SELECT conv_id, turn, name FROM named"))
def sanitize_filename(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", T.sanitize_filename(F.col("text")).alias("name"))


_ERROR = f"""CASE WHEN part IN ('', '.', '..') THEN 'is empty or a dot step'
  WHEN regexp_matches(part, '[\\x00-\\x1f\\x7f<>:"/\\\\|?*]') THEN 'holds a refused character'
  WHEN regexp_matches(part, '^ | $|[.]$') THEN 'begins or ends with a space, or ends with a dot'
  WHEN {_RESERVED.format(x='part')} THEN 'is a device name'
  WHEN length(part) > 255 THEN 'has over 255 characters' END"""


@query(f"SELECT conv_id, turn, {_ERROR} AS error FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN role WHEN 2 THEN 'con.' || role WHEN 3 THEN role || ' ' ELSE substr(text, 1, 1) || '.' END AS part FROM conversations)")
def component_errors(t: Tables) -> DataFrame:
    part = F.expr("CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN role WHEN 2 THEN concat('con.', role) WHEN 3 THEN concat(role, ' ') ELSE concat(substr(text, 1, 1), '.') END")
    return turns(t).select("conv_id", "turn", T.component_error(part).alias("error"))


@query(
    f"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/' || {URL_PATH} WHEN 2 THEN replace({URL_PATH}, '/', '\\') ELSE rtrim({URL_PATH}, '/') END AS path FROM pages),
parts AS (SELECT page_id, path, regexp_split_to_array(path, '[/\\\\]') AS parts FROM p),
errors AS (SELECT page_id, i, {_ERROR} AS error FROM (SELECT page_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM parts)),
first AS (SELECT page_id, min_by(error, i) AS error FROM errors WHERE error IS NOT NULL GROUP BY 1)
SELECT page_id, array_to_string(parts, '>') AS parts,
  CASE WHEN trim(path) = '' THEN 'no path' WHEN regexp_matches(path, '^[/\\\\]|^[A-Za-z]:') THEN 'not relative to the package' ELSE error END AS error
FROM parts LEFT JOIN first USING (page_id)"""
)
def archive_paths(t: Tables) -> DataFrame:
    plain = url_path()
    path = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("/"), plain)).when(F.col("page_id") % 4 == 2, F.replace(plain, F.lit("/"), F.lit("\\"))).otherwise(F.regexp_replace(plain, "/+$", ""))
    rows = t.pages.select("page_id", path.alias("path"))
    return rows.select("page_id", F.array_join(T.path_parts(F.col("path")), ">").alias("parts"), T.path_error(F.col("path")).alias("error"))


_IDENTIFIER = "CASE WHEN regexp_matches({x}, '^[0-9]') THEN '_' ELSE '' END || regexp_replace({x}, '[^_0-9A-Za-z]+', '_', 'g')"


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.strip_accents(F.col("text")).alias("plain"))


@query(f"SELECT conv_id, turn, {_IDENTIFIER.format(x='strip_accents(text)')} AS name FROM conversations")
def identifier_names(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", T.identifier_name(F.col("text")).alias("name"))


@query(f"SELECT conv_id, turn, lower({_IDENTIFIER.format(x='strip_accents(text)')}) AS slug FROM conversations")
def slugify(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", T.slugify(F.col("text")).alias("slug"))


@query("SELECT raw, count(*) AS n, CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes', 'on', 't', 'y') THEN true WHEN lower(trim(raw)) IN ('false', '0', 'no', 'off', 'f', 'n', '') THEN false END AS flag, CASE WHEN lower(trim(raw)) NOT IN ('true', '1', 'yes', 'on', 't', 'y', 'false', '0', 'no', 'off', 'f', 'n', '') THEN 'not a boolean: ' || raw END AS error FROM (SELECT unnest([l_returnflag, ' ' || l_linestatus, CAST(l_linenumber % 3 AS VARCHAR)]) AS raw FROM lineitem) GROUP BY 1")
def coerce_bool(t: Tables) -> DataFrame:
    raw = F.explode(F.array("l_returnflag", F.concat(F.lit(" "), "l_linestatus"), (F.col("l_linenumber") % 3).cast("string")))
    counted = t.lineitem.select(raw.alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return counted.select("raw", "n", T.coerce_bool(F.col("raw")).alias("flag"), T.bool_error(F.col("raw")).alias("error"))


#: A query text for every customer.
_TEXT = """'SELECT * FROM "' || c_mktsegment || '" s JOIN db.nation' || c_nationkey || ' n ON s.k' || (c_custkey % 7) || ' = n.key AND n.x >= 3 join [T ' || (c_custkey % 3) || '] WHERE c' || c_nationkey || '=n . c AND a <> b'"""


def _texts(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.expr(_TEXT).alias("sql"))


#: Equations as they are written: at the end of a statement, beside operators, quotes, brackets and comments.
_EQUATED = f"""{_TEXT} || CASE c_custkey % 6 WHEN 0 THEN '; select p' || c_nationkey || ' = b.q;' WHEN 1 THEN ' or a.x' || c_nationkey || '=b.y||''z''' WHEN 2 THEN ' and `a`.u = b . v' || c_nationkey
WHEN 3 THEN ' and (f(g)=h) and m = n(2) -- i =j' WHEN 4 THEN ' and t == 1 and k=' || chr(10) || 'l.k and "o" = w' ELSE ' and r<=s and 1.5= e and z= ''y''' END"""
_IS_WORD = r"regexp_matches({}, '^[\pL\pN_]')"
_TOKENS = r"regexp_extract_all(sql, '[\pL\pN_]+|[^\s]')"


@query(
    f"""WITH q AS (SELECT c_custkey, {_EQUATED} AS sql FROM customer), t AS (SELECT c_custkey, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS i FROM q),
l AS (SELECT *, lag(token) OVER w AS before, lead(token) OVER w AS after, lead(token, 2) OVER w AS dot, lead(token, 3) OVER w AS last FROM t WINDOW w AS (PARTITION BY c_custkey ORDER BY i)),
s AS (SELECT c_custkey, before, CASE WHEN dot = '.' AND {_IS_WORD.format('last')} THEN last ELSE after END AS behind FROM l WHERE token = '=' AND {_IS_WORD.format('before')} AND {_IS_WORD.format('after')})
SELECT c_custkey, before AS name FROM s UNION SELECT c_custkey, behind FROM s"""
)
def equality_operands(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.explode(T.equality_operands(F.expr(_EQUATED))).alias("name"))


_Q = r"""(?:"[^"]+"|`[^`]+`|\[[^\]]+\]|\w+)"""
_HEADS = rf"list_transform(string_split_regex(sql, '(?i)\b(?:from|join)\s+')[2:], lambda x: regexp_replace(regexp_extract(x, '^(?:{_Q}\s*\.\s*)*({_Q})', 1), '^[\"`\[]|[\"`\]]$', '', 'g'))"


@query(f"WITH q AS (SELECT c_custkey, {_TEXT} AS sql FROM customer) SELECT DISTINCT c_custkey, unnest({_HEADS}) AS name FROM q")
def source_tables(t: Tables) -> DataFrame:
    return _texts(t).select("c_custkey", F.explode(T.source_tables(F.col("sql"))).alias("name"))


_ASSET = f"CASE page_id % 5 WHEN 0 THEN ':' WHEN 1 THEN 'base64:' WHEN 2 THEN '/home/proj/' ELSE '/' END || {URL_PATH}"


@query(f"WITH p AS (SELECT page_id, {_ASSET} AS path FROM pages) SELECT page_id, CASE WHEN starts_with(path, 'base64:') OR starts_with(path, ':') OR starts_with(path, '/www.') THEN NULL WHEN starts_with(path, '/home/proj/') THEN 'resources/' || substr(path, 12) ELSE 'resources/_ext/' || substr(sha256(path), 1, 8) || '_' || split_part(path, '/', -1) END AS name FROM p")
def asset_names(t: Tables) -> DataFrame:
    lead = F.expr("CASE page_id % 5 WHEN 0 THEN ':' WHEN 1 THEN 'base64:' WHEN 2 THEN '/home/proj/' ELSE '/' END")
    return t.pages.select("page_id", T.asset_name(F.concat(lead, url_path()), "/home/proj", ("/www.",)).alias("name"))


@query(
    """WITH p AS (SELECT page_id, html, list_distinct(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS links FROM pages),
m AS (SELECT page_id, html, list_sort(links) AS links FROM p)
SELECT page_id, list_reduce(list_prepend(html, links), lambda d, x: replace(d, x, repeat('../', CAST(page_id % 3 AS INT)) || 'resources' || x)) AS html FROM m"""
)
def rewrite_assets(t: Tables) -> DataFrame:
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]+)"'), F.lit(1))))
    mapping = F.transform(links, lambda x: F.struct(x.alias("original"), F.concat(F.lit("resources"), x).alias("name")))
    return t.pages.select("page_id", T.rewrite_assets(F.col("html"), mapping, (F.col("page_id") % 3).cast("int")).alias("html"))


@query(_sanitized("(SELECT c_custkey AS stratum_id, c_mktsegment || ': ' || c_name || '.' AS raw_name FROM customer)", "raw_name", "SELECT stratum_id, raw_name, name FROM named"))
def stratum_names(t: Tables) -> DataFrame:
    rows = strata.snapshot(t.customer, "c_custkey", ["c_mktsegment", "c_name"])
    return strata.named(rows, "concat(c_mktsegment, ': ', c_name, '.')").select("stratum_id", "raw_name", "name")


@query("SELECT c_custkey AS stratum_id, c_mktsegment || CASE WHEN c_custkey % 10 = 0 THEN '//' ELSE '/' END || c_name AS package_rel, 'n' || c_nationkey AS bundle_rel, CASE WHEN c_custkey % 10 = 0 THEN 'is empty or a dot step' END AS path_error FROM customer")
def package_paths(t: Tables) -> DataFrame:
    rows = strata.named(strata.snapshot(t.customer, "c_custkey", ["c_mktsegment", "c_name", "c_custkey", "c_nationkey"]), "c_name")
    rows = strata.with_paths(rows, "concat(c_mktsegment, if(c_custkey % 10 = 0, '//', '/'), name)", "concat('n', c_nationkey)")
    return rows.select("stratum_id", "package_rel", "bundle_rel", "path_error")


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t: Tables) -> DataFrame:
    return strata.duplicate_names(t.part, "p_name")


_WORDS = "SELECT regexp_replace(word, '[^\\p{L}]', '', 'g') AS word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations)"


def _words(t: Tables) -> DataFrame:
    return t.conversations.select(F.explode(F.split("text", " ")).alias("word")).select(F.regexp_replace("word", r"[^\p{L}]", "").alias("word"))


@query(f"SELECT lower(replace(word, 'ß', 'ss')) AS folded, array_to_string(list_sort(list(DISTINCT word)), ' ') AS spellings FROM ({_WORDS}) GROUP BY 1 HAVING count(DISTINCT word) > 1")
def name_collisions(t: Tables) -> DataFrame:
    return strata.collisions(_words(t), "word").select("folded", F.array_join("spellings", " ").alias("spellings"))


@query(f"SELECT role, lower(replace(path, 'ß', 'ss')) AS folded, array_to_string(list_sort(list(DISTINCT path)), ' ') AS spellings FROM (SELECT role, 'a/' || unnest(string_split(text, ' ')) AS path FROM conversations) GROUP BY 1, 2 HAVING count(DISTINCT path) > 1")
def path_collisions(t: Tables) -> DataFrame:
    paths = t.conversations.select("role", F.explode(F.split("text", " ")).alias("word")).select("role", F.concat(F.lit("a/"), "word").alias("path"))
    return strata.collisions(paths, "path", "role").select("role", "folded", F.array_join("spellings", " ").alias("spellings"))


def _customers(t: Tables) -> DataFrame:
    rows = strata.named(strata.snapshot(t.customer, "c_custkey", ["c_mktsegment", "c_nationkey", "c_name"]), "c_name")
    return strata.with_paths(rows, "concat(if(stratum_id % 2 = 0, c_mktsegment, lower(c_mktsegment)), '/', stratum_id % 40)", "concat('n', c_nationkey)")


_BUNDLED = "(SELECT c_custkey, c_name, 'n' || c_nationkey AS bundle_rel, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END || '/' || (c_custkey % 40) AS package_rel FROM customer)"


@query(f"SELECT bundle_rel, string_agg(c_name, ',' ORDER BY c_custkey) AS members FROM {_BUNDLED} GROUP BY 1")
def bundles(t: Tables) -> DataFrame:
    return strata.bundles(_customers(t)).select("bundle_rel", F.array_join("members", ",").alias("members"))


@query(f"SELECT bundle_rel, lower(package_rel) AS folded, count(*) AS n FROM {_BUNDLED} GROUP BY 1, 2 HAVING count(*) > 1")
def bundle_collisions(t: Tables) -> DataFrame:
    return strata.bundle_collisions(_customers(t))


@query("SELECT event_type, round(sum(s), 4) AS total, string_agg(user_id, ', ' ORDER BY s DESC, user_id DESC) FILTER (WHERE k <= 3) AS slowest FROM (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, sum(value) AS s, row_number() OVER (PARTITION BY event_type ORDER BY sum(value) DESC, CAST(user_id AS VARCHAR) DESC) AS k FROM events GROUP BY 1, 2) GROUP BY 1")
def slowest_steps(t: Tables) -> DataFrame:
    timings = t.events.select("event_type", F.col("user_id").cast("string").alias("user"), "value")
    return reports.slowest(timings, "event_type", "user", "value").select("event_type", F.round("total", 4).alias("total"), "slowest")


@query("SELECT p_partkey AS ord, CASE WHEN k = 1 THEN p_name ELSE p_name || '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(replace(p_name, 'ß', 'ss')) ORDER BY p_partkey) AS k FROM part)")
def dedupe_names(t: Tables) -> DataFrame:
    return strata.dedupe_names(t.part, "p_partkey", "p_name")


#: A third of all orders have one name, a third of the others far numbers of it, which they keep, or near ones, which are taken when they come.
_HOT = "CASE WHEN o_orderkey % 3 = 0 THEN 'hot' WHEN o_orderkey % 6 = 1 THEN 'hot_' || 2 * o_orderkey WHEN o_orderkey % 6 = 4 THEN 'Hot_' || (o_orderkey {} 6) ELSE 'n' || o_orderkey END"


@query(
    f"""WITH o AS (SELECT o_orderkey AS ord, {_HOT.format('//')} AS name FROM orders), claimed AS (SELECT 2 * ord AS j FROM o WHERE ord % 6 = 1),
hot AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k FROM o WHERE ord % 3 = 0), free AS (SELECT j, row_number() OVER (ORDER BY j) + 1 AS k FROM (SELECT unnest(range(2, 3 * (SELECT count(*) FROM o) + 10)) AS j) WHERE j NOT IN (SELECT j FROM claimed))
SELECT ord, CASE WHEN ord % 3 > 0 THEN name || CASE WHEN ord % 6 = 4 AND ord // 6 >= 2 THEN '_2' ELSE '' END WHEN hot.k = 1 THEN name ELSE name || '_' || j END AS unique_name
FROM o LEFT JOIN hot USING (ord) LEFT JOIN free USING (k)"""
)
def dedupe_hot(t: Tables) -> DataFrame:
    return strata.dedupe_names(t.orders.select("o_orderkey", F.expr(_HOT.format("div")).alias("name")), "o_orderkey", "name")


@query("SELECT r_regionkey AS stratum_id, l AS layer_id, CASE WHEN r_name <> 'ASIA' OR l = 'orders' THEN upper(l) || ' of ' || r_name END AS display_name, NOT (r_name <> 'ASIA' OR l = 'orders') AS failed FROM (SELECT DISTINCT r_regionkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), (SELECT unnest(['orders', 'events']) AS l)")
def display_names(t: Tables) -> DataFrame:
    """Names for the strata that have orders; the expression fails for one of them."""
    from zonepack.queries.matching import packager

    p = packager(t, layers=["orders", "events"])
    used = strata.snapshot(p.strata, "stratum_id", ["raw_name", "name"], selection=p.membership("orders").select("stratum_id").distinct())
    layers = t.spark.createDataFrame([(i, i.upper()) for i in p.layer_ids], "layer_id string, layer_name string")
    return strata.display_names(used, layers, "CASE WHEN stratum_name <> 'ASIA' OR layer_id = 'orders' THEN concat(layer_name, ' of ', stratum_name_sanitized) END")
