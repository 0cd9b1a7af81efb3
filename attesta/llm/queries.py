"""The queries of this subpackage's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import divergence, exact_topk, filter_audit, html_text, licenses, nearest, packing, quality, run_index, secrets, simhash, toxicity, word_bpe
from attesta.llm._common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.remove_repeats(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_html, op3_quality, op4_secrets, op5_simhash, op6_packing, op7_topk, op8_bpe, op9_nearest, op10_licenses, op11_divergence, op12_filters, op13_repeats, pipeline)}

#: The patterns of secrets.py in the words of another engine, with quotes doubled for SQL.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
IDENT = r"""(?i:access_?key(?:_?id)?|client_?id|user_?name|login|account)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""[0-9+]*[A-Za-z][A-Za-z0-9+]*://[A-Za-z0-9._~:/?#@!$&''()*+,;=%-]+"""

LICENSES = ", ".join(f"({n}, '{phrase}', '{label}')" for n, (phrase, label) in enumerate(licenses.TEMPLATES))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    # For pages whose text is their only article element, as in the test tables; pages of other kinds are in the tests.
    "op2_html": r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS h FROM pages),
b AS (SELECT page_id, url, [regexp_replace(x, '<[^>]*>', '', 'g') FOR x IN string_split_regex(replace(h, '<br>', ' '), '</?(?:p|h1)>')] AS parts FROM a),
c AS (SELECT page_id, url, [trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) FOR x IN parts] AS t FROM b)
SELECT page_id, url, array_to_string([x FOR x IN t IF x <> ''], chr(10) || chr(10)) AS text, length(array_to_string([x FOR x IN t IF x <> ''], chr(10) || chr(10)))::BIGINT AS n_chars FROM c""",
    # Matches by kind, their places one after another, then the interval join of weak spans with complementary ones.
    "op4_secrets": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, 0 AS kind, regexp_extract_all(text, '{ASSIGN}') AS vs FROM d UNION ALL SELECT r, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d UNION ALL SELECT r, 2, regexp_extract_all(text, '[0-9a-f]{{32,}}') FROM d
 UNION ALL SELECT r, 3, regexp_extract_all(text, '{IDENT}') FROM d UNION ALL SELECT r, 4, regexp_extract_all(text, '{ENDPOINT}') FROM d UNION ALL SELECT r, 5, regexp_extract_all(text, '[A-Za-z0-9+/_.=-]{{24,}}') FROM d),
w AS (SELECT r, kind, vs, 1 AS i, 0 AS off FROM m WHERE len(vs) > 0 UNION ALL SELECT w.r, kind, vs, i + 1, off + instr(substr(text, off + 1), vs[i]) - 1 + length(vs[i]) FROM w JOIN d USING (r) WHERE i <= len(vs)),
p AS (SELECT r, kind, vs[i - 1] AS v, off - length(vs[i - 1]) AS a, regexp_extract(vs[i - 1], '^([A-Za-z0-9+/]{{24,}}={{0,2}})(?:\.|$)', 1) AS bare FROM w WHERE i > 1),
s AS (SELECT r, kind, a, a + length(CASE WHEN kind = 5 THEN bare ELSE v END) AS b FROM p
 WHERE CASE kind WHEN 0 THEN length(regexp_extract(v, '{ASSIGN}', 1)) >= 8 WHEN 1 THEN length(v) >= 16 WHEN 5 THEN regexp_matches(bare, '[0-9]') AND regexp_matches(bare, '[A-Za-z]') ELSE true END),
x AS (SELECT DISTINCT l.* FROM s l JOIN s o ON l.r = o.r AND l.kind >= 3 AND CASE WHEN l.kind = 5 THEN o.kind IN (1, 3, 4) ELSE o.kind IN (0, 2, 5) END AND (o.b <= l.a OR o.a >= l.b) AND abs(l.a - o.a) <= 400),
t AS (SELECT *, ['assign', 'access', 'hex', 'ident', 'endpoint', 'bare'][kind + 1] || ':' || a || ':' || b AS name FROM (SELECT * FROM s WHERE kind < 3 UNION ALL SELECT * FROM x))
SELECT doc_id, count(t.r) FILTER (kind = 0) AS n_assign, count(t.r) FILTER (kind = 1) AS n_access, count(t.r) FILTER (kind = 2) AS n_hex,
 sha256(coalesce(string_agg(name, ',' ORDER BY a, kind, b) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(name, ',' ORDER BY a, kind, b), '') AS spans, count(t.r) FILTER (kind >= 3) AS n_linked
FROM d LEFT JOIN t USING (r) GROUP BY d.r, doc_id""",
    # Word pairs that texts share with templates, their diagonals, islands of near diagonals, and the longest chains in order.
    "op10_licenses": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tpl AS (SELECT n, label, string_split(phrase, ' ') AS p FROM (VALUES {LICENSES}) v(n, phrase, label)), size AS (SELECT n, label, len(p) - 1 AS grams FROM tpl),
tg AS (SELECT n, s AS spot, p[s + 1] || ' ' || p[s + 2] AS gram FROM (SELECT n, p, unnest(range(0, len(p) - 1)) AS s FROM tpl)),
g AS (SELECT r, s AS pos, words[s + 1] || ' ' || words[s + 2] AS gram FROM (SELECT r, words, unnest(range(0, greatest(len(words) - 1, 0))) AS s FROM d)),
h AS (SELECT DISTINCT r, n, pos, spot, pos - spot AS diag FROM g JOIN tg USING (gram)), ln AS (SELECT r, n, diag, count(*) AS votes FROM h GROUP BY ALL),
isl AS (SELECT r, n, diag, votes, sum(new) OVER (PARTITION BY r, n ORDER BY diag) AS island FROM (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, n ORDER BY diag) <= 2 THEN 0 ELSE 1 END AS new FROM ln)),
mg AS (SELECT r, n, island, label, grams, max(diag) - min(diag) AS drift, bool_or(votes = grams) AS consecutive, count(*) FILTER (votes = grams AND n < {len(licenses.BASE)}) AS whole, min(diag) FILTER (votes = grams AND n < {len(licenses.BASE)}) AS low, max(diag) FILTER (votes = grams AND n < {len(licenses.BASE)}) AS high FROM isl JOIN size USING (n) GROUP BY ALL),
hi AS (SELECT r, n, island, pos, spot FROM h JOIN isl USING (r, n, diag) JOIN mg USING (r, n, island) WHERE grams > 2 AND NOT consecutive),
ch AS (SELECT *, 1 AS k FROM hi UNION SELECT b.*, k + 1 FROM ch a JOIN hi b ON a.r = b.r AND a.n = b.n AND a.island = b.island AND b.pos > a.pos AND b.spot > a.spot),
best AS (SELECT r, n, island, max(k) AS chain FROM ch GROUP BY ALL),
sp AS (SELECT mg.*, CASE WHEN consecutive THEN 1.0::DOUBLE WHEN chain / grams >= 0.8 AND drift <= greatest(2, grams // 2) THEN chain / grams END AS share FROM mg LEFT JOIN best USING (r, n, island))
SELECT doc_id, len(words) AS n_words, coalesce(sum(whole), 0)::BIGINT AS n_base, min(low)::BIGINT AS first_word, max(high)::BIGINT AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole > 0), '') AS base_labels,
 coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share IS NOT NULL), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score FROM d LEFT JOIN sp USING (r) GROUP BY d.r, doc_id, words""",
    "op7_topk": """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    # Shares of every kept term in every group, by joins; whole numbers of any size.
    "op11_divergence": rf"""
WITH w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kt AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30), ln AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM kt GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL), gc AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM grp g JOIN kt k USING (lang) LEFT JOIN c USING (lang, source, term)),
gn AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM gc GROUP BY ALL),
p AS (SELECT lang, source, term, c, 1 + 1000000000::HUGEINT * (c + 5) // (gn.n + 5 * v) AS p FROM gc JOIN gn USING (lang, source) JOIN ln USING (lang)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 5) // (n + 5 * v) AS q FROM kt JOIN ln USING (lang)),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT a.lang, a.source AS s1, b.source AS s2, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.s1 = a.source AND x.s2 = b.source
 UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p.p > q.q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
    # Documents by the filters that they fail; at each step of each order the first failing filter removes.
    "op12_filters": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT part, doc_id, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails FROM x),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
s AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS ord FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5), st AS (SELECT ord, k AS step, substr(ord, k, 1) AS f, left(ord, k - 1) AS done FROM o, (SELECT unnest(range(1, 6)) AS k)),
t AS (SELECT part, ord, step, f, n, good, toxic, fails, contains(fails, f) AS failing, translate(fails, done, '') <> fails AS gone FROM s, st),
a AS (SELECT part, ord, step, f, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed, sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (fails = f) AS alone, sum(n) FILTER (failing AND NOT gone AND good) AS good_lost, sum(n) FILTER (failing AND NOT gone AND toxic) AS toxic_lost FROM t GROUP BY ALL)
SELECT part, ord AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(alone, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
 (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM a""",
}
