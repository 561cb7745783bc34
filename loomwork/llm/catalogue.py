"""One query opN_<name> for each operator of this subpackage, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.llm import decontamination, html_extraction, language_id, lm_scoring, ngram_join, quality_rules, source_mixing, substring_dedup, token_counts, url_filters
from loomwork.session import load_table

QUERIES = {}
ORACLE = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op4_token_counts(spark, folder):
    import public_tokenizers

    return token_counts.count_tokens(load_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Words of a text in DuckDB, and its A-Z lower-casing.
SQL_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op6_quality_rules(spark, folder):
    return quality_rules.judge_documents(load_table(spark, folder, "documents"))


ORACLE["op6_quality_rules"] = f"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {SQL_WORDS.format("text")} AS ws FROM documents
), lines AS (
  SELECT doc_id, source, md5(text) AS text_key, line, {SQL_WORDS.format("line")} AS ws
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM texts)
), worded AS (
  SELECT *, {SQL_LOWER.format("array_to_string(ws, ' ')")} AS normal FROM lines WHERE len(ws) > 0
), hosts AS (
  SELECT source, count(DISTINCT (doc_id, md5(text))) AS host_documents FROM texts GROUP BY source
), counts AS (
  SELECT source, normal, count(DISTINCT (doc_id, text_key)) AS n FROM worded GROUP BY source, normal
), removed AS (
  SELECT c.source, c.normal FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > {quality_rules.LINE_DOCUMENTS} AND (c.n > {quality_rules.LINE_SHARE} * h.host_documents OR c.n > {quality_rules.LINE_MOST})
), lost AS (
  SELECT w.doc_id, sum(len(w.ws)) AS lost FROM worded w JOIN removed r ON w.source IS NOT DISTINCT FROM r.source AND w.normal = r.normal
  GROUP BY w.doc_id
), dup_lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM texts)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, len(t.ws) AS n_words, coalesce(list_sum(list_transform(t.ws, lambda w: length(w))), 0) AS word_chars,
    length(t.text) - length(translate(t.text, '#*$%&|<>', '')) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.lost, 0) AS n_removed_words
  FROM texts t LEFT JOIN dup_lines d USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(n_removed_words AS BIGINT) AS n_removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_removed_words > 0 AND
    (n_words - n_removed_words < {quality_rules.LEFT_SHARE} * n_words OR n_words - n_removed_words < {quality_rules.LEAST_WORDS})) AS kept
FROM counted
"""

#: The texts without removed lines, of documents that have some: beside the verdict, what the pipeline's first stage passes on.
LEFT_TEXT = f"""
WITH lines AS (
  SELECT doc_id, source, md5(text) AS text_key, pos, line, {SQL_LOWER.format("array_to_string(" + SQL_WORDS.format("line") + ", ' ')")} AS normal FROM (
    SELECT doc_id, source, text, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM (
      SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), removed AS (
  SELECT c.source, c.normal FROM (SELECT source, normal, count(DISTINCT (doc_id, text_key)) AS n FROM lines WHERE normal <> '' GROUP BY source, normal) c
  JOIN (SELECT source, count(DISTINCT (doc_id, text_key)) AS h FROM lines GROUP BY source) h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > {quality_rules.LINE_DOCUMENTS} AND (c.n > {quality_rules.LINE_SHARE} * h.h OR c.n > {quality_rules.LINE_MOST})
)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE r.normal IS NULL), '') AS left_text
FROM lines l LEFT JOIN removed r ON l.source IS NOT DISTINCT FROM r.source AND l.normal = r.normal
GROUP BY l.doc_id HAVING count(r.normal) > 0
"""

#: The rules of the query (action, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op8_url_filters(spark, folder):
    return url_filters.judge_urls(load_table(spark, folder, "pages"), url_filters.rule_table(spark, URL_RULES))


ORACLE["op8_url_filters"] = f"""
WITH rules(action, rule_host, rule_path) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
rests AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, {SQL_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), fits AS (
  SELECT p.page_id, r.rule_host || r.rule_path AS rule, r.action,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC, r.action DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON p.page_id = f.page_id
"""


@query
def op7_source_mixing(spark, folder):
    """``shards``: the output shards that draw the document, in the order of the passes."""
    mixed = source_mixing.mix_documents(load_table(spark, folder, "documents"))
    shards = F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def sql_hypergeometric(items: str, good: str, taken: str, u: str) -> str:
    """How many of the good are among those taken, by the inverse distribution function: the first x whose sum reaches u."""
    low, high = f"greatest(0, {good} + {taken} - {items})", f"least({good}, {taken})"
    chance = f"- lgamma(x + 1) - lgamma({good} - x + 1) - lgamma({taken} - x + 1) - lgamma({items} - {good} - {taken} + x + 1)"
    logs = f"list_transform(range({low}, {high} + 1), lambda x: {chance})"
    chances = f"list_transform({logs}, lambda l: exp(l - list_max({logs})))"
    reached = f"list_filter(range(1, {high} - {low} + 2), lambda i: list_sum(list_slice(p, 1, i)) >= {u} * list_sum(p))"
    return f"(CASE WHEN {low} >= {high} THEN {high} ELSE (SELECT {low} + coalesce({reached}[1], len(p)) - 1 FROM (SELECT {chances} AS p)) END)"


def sql_tree(levels: int) -> str:
    """CTEs node0 to node<levels> from quotas(key, n): (node, i, key, n), the i-th source by key."""
    out = ["node0 AS (SELECT '' AS node, row_number() OVER (ORDER BY key) AS i, key, n FROM quotas)"]
    for at in range(levels):
        u = "CAST(CAST('0x' || substring(md5(concat_ws(':', '7', 'tree', node, key)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"
        out.append(f"""split{at}(node, i, items, taken, key, n, drawn) AS (
  SELECT node, CAST(0 AS BIGINT), CAST(sum(n) AS BIGINT), CAST(ceil(sum(n) / 2) AS BIGINT), '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM node{at} GROUP BY node
  UNION ALL
  SELECT node, i, items, taken, key, n, CAST({sql_hypergeometric("items", "n", "taken", "u")} AS BIGINT) FROM (
    SELECT *, {u} AS u FROM (SELECT s.node, x.i, s.items - s.n AS items, s.taken - s.drawn AS taken, x.key, x.n FROM split{at} s JOIN node{at} x ON x.node = s.node AND x.i = s.i + 1))
), node{at + 1} AS (
  SELECT node || half AS node, i, key, CASE WHEN half = '0' THEN drawn ELSE n - drawn END AS n FROM split{at}, (VALUES ('0'), ('1')) h(half) WHERE i > 0
)""")
    return ", ".join(out)


SQL_LEVELS = source_mixing.LEAST_SHARDS.bit_length() - 1

#: A row for each document and draw of it (shard null without any), for the least number of shards: SHARD_WORDS words each.
MIX_DRAWS = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))) AS hash, CAST(len({SQL_WORDS.format("text")}) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT key, sum(size) AS source_size, (row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS weight FROM base GROUP BY key
), ratios AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY 3 * source_size / weight, key
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sizes
), levels AS (
  SELECT arg_min(level, (cap / weight, key)) AS level FROM ratios WHERE level <= cap / weight
), sources AS (
  SELECT key, source_size, target, whole, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM (
      SELECT r.key, r.source_size, least(l.level * r.weight, CAST(r.cap AS DOUBLE)) AS target FROM ratios r, levels l))
), blocks AS (
  SELECT key, block, words, sum(words) OVER (PARTITION BY key ORDER BY block) AS until
  FROM (SELECT key, substring(hash, 1, 2) AS block, sum(size) AS words FROM base GROUP BY 1, 2)
), cuts AS (
  SELECT key, block, rest - until + words AS left_over FROM blocks JOIN sources USING (key) WHERE until > rest AND until - words <= rest
), inside AS (
  SELECT b.key, c.left_over, b.hash, sum(b.size) OVER (PARTITION BY b.key ORDER BY b.hash) AS until
  FROM base b JOIN cuts c ON b.key = c.key AND substring(b.hash, 1, 2) = c.block
), ends AS (
  SELECT c.key, c.block, coalesce(max(i.hash), '') AS cut_hash, any_value(c.left_over) - coalesce(max(i.until), 0) AS gap
  FROM cuts c LEFT JOIN (SELECT * FROM inside WHERE until <= left_over) i USING (key) GROUP BY c.key, c.block
), nearest AS (
  SELECT b.key, arg_min(b.hash, (abs(e.gap - b.size), b.hash)) AS fit_hash FROM base b JOIN ends e USING (key)
  WHERE e.gap > 0 AND substring(b.hash, 1, 2) >= e.block AND b.hash > e.cut_hash AND abs(e.gap - b.size) < e.gap GROUP BY b.key
), units AS (
  SELECT key, unnest(range(1, whole + 1)) AS pass, block, 'all' AS kind FROM blocks JOIN sources USING (key)
  UNION ALL SELECT key, whole + 1, block, 'all' FROM blocks JOIN sources USING (key) WHERE until <= rest
  UNION ALL SELECT key, whole + 1, block, 'part' FROM ends JOIN sources USING (key)
  UNION ALL SELECT key, whole + 1, substring(fit_hash, 1, 2), 'one' FROM nearest JOIN sources USING (key)
), permuted AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat_ws(':', '7', 'unit', key, pass, block, kind))) - 1 AS at FROM units
), quotas AS MATERIALIZED (
  SELECT key, count(*) AS n FROM permuted GROUP BY key
), {sql_tree(SQL_LEVELS)}, leaves AS MATERIALIZED (
  SELECT key, shard, n, sum(n) OVER (PARTITION BY key ORDER BY shard) AS stop
  FROM (SELECT key, n, {" + ".join(f"CAST(substring(node, {k + 1}, 1) AS INT) * {1 << (SQL_LEVELS - 1 - k)}" for k in range(SQL_LEVELS))} AS shard FROM node{SQL_LEVELS})
), dealt AS (
  SELECT u.*, l.shard FROM permuted u JOIN leaves l ON l.key = u.key AND u.at < l.stop AND u.at >= l.stop - l.n
)
SELECT b.doc_id, b.size, CAST(s.source_size AS BIGINT) AS source_size, s.target, u.pass, u.shard
FROM base b JOIN sources s USING (key) LEFT JOIN ends e ON e.key = b.key LEFT JOIN nearest n ON n.key = b.key
LEFT JOIN dealt u ON u.key = b.key AND u.block = substring(b.hash, 1, 2) AND b.size > 0 AND
  (u.kind = 'all' OR u.kind = 'part' AND b.hash <= e.cut_hash OR u.kind = 'one' AND b.hash = n.fit_hash)
"""

ORACLE["op7_source_mixing"] = f"""
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(any_value(size) * count(shard) AS BIGINT) AS taken, coalesce(string_agg(CAST(shard AS VARCHAR), ',' ORDER BY pass), '') AS shards
FROM ({MIX_DRAWS}) GROUP BY doc_id
"""


@query
def op5_substring_dedup(spark, folder):
    kept = substring_dedup.remove_repeats(load_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


KEPT_TEXT = f"""
WITH texts AS (
  SELECT doc_id, {SQL_WORDS.format("text")} AS ws FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM texts)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first_id FROM windows) WHERE first_id < doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM texts
), marked AS (
  SELECT w.doc_id, w.i, w.word, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS latest
  FROM words w LEFT JOIN repeated r ON r.doc_id = w.doc_id AND r.i = w.i
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM marked WHERE latest IS NULL OR i - latest >= 50 GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(len(t.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, coalesce(k.t, '') AS kept_text
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
ORACLE["op5_substring_dedup"] = f"SELECT doc_id, n_words, n_removed, sha256(kept_text) AS kept_sha256 FROM ({KEPT_TEXT})"


@query
def op10_decontamination(spark, folder):
    return decontamination.find_leaks(load_table(spark, folder, "documents"), load_table(spark, folder, "benchmark"))


ORACLE["op10_decontamination"] = r"""
WITH items AS (
  SELECT item_id, len(ws) AS n, greatest(len(ws) - 4, 1) AS m, ws FROM
    (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM benchmark) WHERE len(ws) > 0
), item_shingles AS (
  SELECT item_id, n, m, array_to_string(list_slice(ws, p, p + least(n, 5) - 1), ' ') AS h, count(*) AS c
  FROM (SELECT *, unnest(range(1, m + 1)) AS p FROM items) GROUP BY ALL
), texts AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents
), widths AS (
  SELECT DISTINCT least(n, 5) AS k FROM items
), shingles AS (
  SELECT doc_id, k, len(ws) AS n_words, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS h
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM texts, widths)
), hits AS (
  SELECT DISTINCT s.doc_id, x.item_id, x.n, x.m, s.n_words, s.i FROM shingles s JOIN item_shingles x ON s.h = x.h AND s.k = least(x.n, 5)
), windows AS (
  SELECT DISTINCT doc_id, item_id, n, m, start FROM
    (SELECT *, unnest(range(i - m + 1, i + 1)) AS start FROM hits) WHERE start >= 1 AND start + n - 1 <= n_words
), weights AS (
  SELECT w.doc_id, w.item_id, w.n, w.m, w.start, s.h, count(*) AS c
  FROM windows w JOIN shingles s ON s.doc_id = w.doc_id AND s.k = least(w.n, 5) AND s.i >= w.start AND s.i < w.start + w.m GROUP BY ALL
), scored AS (
  SELECT w.doc_id, w.item_id, w.n, w.m, w.start, sum(least(w.c, x.c)) AS shared
  FROM weights w JOIN item_shingles x ON x.item_id = w.item_id AND x.h = w.h GROUP BY ALL
)
SELECT doc_id, item_id, CAST(arg_min(start, (-shared, start)) - 1 AS BIGINT) AS start_word, CAST(any_value(n) AS BIGINT) AS n_words,
  CAST(max(shared) AS BIGINT) AS shared_weight, CAST(2 * any_value(m) - max(shared) AS BIGINT) AS total_weight
FROM scored WHERE 100 * shared >= 80 * (2 * m - shared) GROUP BY doc_id, item_id
"""


@query
def op2_ngram_join(spark, folder):
    return ngram_join.similar_groups(load_table(spark, folder, "documents")).drop("text_row")


ORACLE["op2_ngram_join"] = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {SQL_WORDS.format(SQL_LOWER.format("text"))} AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM texts WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = s.x JOIN sizes b ON b.doc_id = s.y WHERE 100 * s.n >= 80 * (a.n + b.n - s.n)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM texts UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT t.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM texts t LEFT JOIN sizes z USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)
"""


@query
def op2_ngram_links(spark, folder):
    return ngram_join.document_links(load_table(spark, folder, "documents"))


ORACLE["op2_ngram_links"] = f"""
WITH texts AS (
  SELECT doc_id, {SQL_WORDS.format(SQL_LOWER.format("text"))} AS ws FROM documents
), classes AS (
  SELECT min(doc_id) AS class_id, ws FROM texts WHERE len(ws) > 0 GROUP BY ws
), shingles AS (
  SELECT DISTINCT class_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT class_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM classes)
), sizes AS (
  SELECT class_id, count(*) AS n FROM shingles GROUP BY class_id
), shared AS (
  SELECT a.class_id AS x, b.class_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.class_id <> b.class_id GROUP BY 1, 2
), links AS (
  SELECT x, count(*) AS n FROM shared s JOIN sizes a ON a.class_id = s.x JOIN sizes b ON b.class_id = s.y WHERE 100 * s.n >= 80 * (a.n + b.n - s.n) GROUP BY x
)
SELECT t.doc_id, coalesce(c.class_id, t.doc_id) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM texts t LEFT JOIN classes c ON c.ws = t.ws LEFT JOIN links l ON l.x = c.class_id
"""


@query
def op9_lm_scoring(spark, folder):
    """The target model learns from documents labelled good and not toxic."""
    good = load_table(spark, folder, "labels").filter("quality = 1 and toxic = 0")
    return lm_scoring.score_documents(load_table(spark, folder, "documents"), good)


@query
def op1_language_id(spark, folder):
    return language_id.identify_languages(load_table(spark, folder, "documents"), spans=False)


@query
def op3_html_extraction(spark, folder):
    return html_extraction.extract_texts(load_table(spark, folder, "pages"))
