"""Queries over texts: loading, cleaning, chunks, tokens, personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import fixed
from attesta.functions import hooks as H
from attesta.functions import text as T
from attesta.operators import chunks as C
from attesta.plans.registry import query
from attesta.sources import tables as S

DOC = """doc AS (SELECT doc_id, source AS tenant_id, lang AS matter_id, doc_id || '.txt' AS filename, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)"""
CHUNK = (
    DOC
    + """, win AS (SELECT doc.*, unnest(range(0, (CASE WHEN length(t) = 0 THEN 0 ELSE ceil(greatest(length(t) - 900, 0) / 740.0) + 1 END)::BIGINT)) AS pos FROM doc),
part AS (SELECT doc_id, tenant_id, matter_id, filename, pos, trim(substr(t, pos * 740 + 1, 900)) AS text FROM win),
num AS (SELECT *, (row_number() OVER (PARTITION BY tenant_id, matter_id, doc_id ORDER BY pos) - 1)::INTEGER AS ordinal FROM part WHERE text <> ''),
chunk AS (SELECT sha256(concat_ws('|', tenant_id, matter_id, doc_id, ordinal)) AS chunk_id, * EXCLUDE (pos) FROM num)"""
)
TOKENS = "[lower(x) FOR x IN regexp_extract_all({0}, '[A-Za-z0-9_]+')]"
EMAIL, SSN, PHONE = (fixed.PII[e][0] for e in ("EMAIL_ADDRESS", "US_SSN", "PHONE_NUMBER"))
CANON = """CASE WHEN length({0}) > 4 AND ends_with({0}, 'ies') THEN left({0}, -3) || 'y' WHEN length({0}) > 4 AND ends_with({0}, 'es') THEN left({0}, -2)
 WHEN length({0}) > 3 AND ends_with({0}, 's') AND NOT ends_with({0}, 'ss') THEN left({0}, -1) ELSE {0} END"""


def chunk_table(spark, d):
    return C.chunk_pages(S.documents(spark, d))


def files(spark, d):
    p = S.table(spark, d, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))


def turns(spark, d):
    c = S.table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("pages"))


@query("r01_load_text", "SELECT page_id AS doc_id, length(html) AS n, md5(html) AS digest FROM pages WHERE trim(regexp_replace(html, '\\s+', ' ', 'g')) <> ''")
def load_text(spark, d):
    return S.load_text(files(spark, d)).select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("r02_load_paged", "SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS page, text FROM conversations QUALIFY trim(text) <> ''")
def load_paged(spark, d):
    return S.load_paged(turns(spark, d))


def pages_at_feeds():
    """An extractor for the query: pages end at form feeds."""
    return lambda contents: [list(enumerate(bytes(c).decode("utf-8").split("\f"), 1)) for c in contents]


@query("r02b_extract_pages", "WITH t AS (SELECT conv_id, string_split(string_agg(text, chr(12) ORDER BY turn), chr(12)) AS parts FROM conversations GROUP BY 1), e AS (SELECT conv_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS page FROM t) SELECT conv_id AS doc_id, page::INTEGER AS page, text FROM e WHERE trim(text) <> ''")
def extract_pages(spark, d):
    """Binary files (a conversation each) opened by an extractor that each task makes once."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    files = S.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.encode(F.array_join(ordered, "\f"), "UTF-8").alias("content"))
    return H.extract_pages(files, pages_at_feeds)


@query("r03_metadata", "SELECT conv_id AS doc_id, sha256(string_agg(text, chr(12) ORDER BY turn)) AS sha256, count(*)::INTEGER AS page_count FROM conversations GROUP BY conv_id")
def metadata(spark, d):
    t = turns(spark, d)
    return S.metadata(t.select("doc_id", F.encode(F.array_join("pages", "\f"), "UTF-8").alias("content")), S.load_paged(t))


@query("r04_admit", "SELECT page_id AS doc_id, CASE WHEN strlen(html) > 4096 THEN 'upload exceeds 0 MB' END AS rejected FROM pages")
def admit(spark, d):
    return S.admit(files(spark, d), S.load_text(files(spark, d)), 4096)


@query("r05_upsert", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def upsert(spark, d):
    e = S.table(spark, d, "events").select("user_id", "event_type", F.col("event_id"), "ts").withColumn("v", F.struct("ts", "event_id"))
    return S.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0"), ["user_id", "event_type"], "v").drop("v")


@query("r06_replace_by", "SELECT doc_id, 'new' AS entity FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def replace_by(spark, d):
    old = S.table(spark, d, "documents").select("doc_id", F.lit("old").alias("entity"))
    return S.replace_by(old, S.table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("new").alias("entity")), "doc_id")


@query("r07_list_chunks", f"WITH {CHUNK} SELECT chunk_id, doc_id, ordinal, text FROM chunk WHERE tenant_id = 'src3' AND matter_id = 'en'")
def list_chunks(spark, d):
    return chunk_table(spark, d).where("tenant_id = 'src3' AND matter_id = 'en'").orderBy("doc_id", "ordinal").select("chunk_id", "doc_id", "ordinal", "text")


@query("r08_list_documents", "SELECT doc_id, doc_id || '.txt' AS filename, lang AS matter_id FROM documents WHERE source = 'src3'")
def list_documents(spark, d):
    return S.documents(spark, d).where("tenant_id = 'src3'").orderBy(F.desc("doc_id")).select("doc_id", "filename", "matter_id")


@query("r13_manifest", "SELECT doc_id || '.txt' AS filename, source, sha256(text) AS sha256, CASE source WHEN 'src1' THEN 'MIT' WHEN 'src2' THEN 'CC-BY' END AS license FROM documents")
def manifest(spark, d):
    rows = S.table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "source", F.encode("text", "UTF-8").alias("content"))
    return S.manifest(rows, F.broadcast(spark.createDataFrame([("src1", "MIT"), ("src2", "CC-BY")], "source string, license string")))


@query("r25_clean_text", f"WITH {DOC} SELECT doc_id, t AS text FROM doc")
def clean_text(spark, d):
    return S.documents(spark, d).select("doc_id", T.clean_text("text").alias("text"))


@query("r26_chunk_pages", f"WITH {CHUNK} SELECT chunk_id, tenant_id, matter_id, doc_id, filename, ordinal, text FROM chunk")
def chunk_pages(spark, d):
    return chunk_table(spark, d).drop("page")


@query("r27_tokenize", f"WITH x AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM x")
def tokenize(spark, d):
    return S.documents(spark, d).withColumn("t", T.tokenize("text")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "r28_canonical_tokens",
    f"WITH x AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark), y AS (SELECT item_id, unnest(t) AS w FROM x UNION SELECT item_id, left(w, -1) FROM (SELECT item_id, unnest(t) AS w FROM x) WHERE length(w) > 3 AND ends_with(w, 's')) SELECT item_id, string_agg(w, ' ' ORDER BY w) AS tokens FROM (SELECT DISTINCT * FROM y) GROUP BY item_id",
)
def canonical_tokens(spark, d):
    return S.table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.canonical_tokens(T.tokenize("text"))), " ").alias("tokens"))


@query("r29_canonical_word", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) SELECT word, {CANON.format('word')} AS canonical FROM w")
def canonical_word(spark, d):
    w = S.table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", T.canonical_word("word").alias("canonical"))


@query("r30_normalize_for_match", "SELECT conv_id, turn, trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g')) AS text FROM conversations")
def normalize_for_match(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", T.normalize_for_match("text").alias("text"))


@query("r31_normalize_for_guard", "SELECT item_id, text FROM benchmark")
def normalize_for_guard(spark, d):
    """Marks put between all letters, and look-alikes put for letters, are undone."""
    spoiled = F.translate(F.regexp_replace("text", "(.)", "$1\u200b"), "aecopxyi", "аесорхуі")
    return S.table(spark, d, "benchmark").select("item_id", T.normalize_for_guard(spoiled).alias("text"))


SPLIT = r"string_split(regexp_replace({0}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"


@query("r32_sentences", f"WITH s AS (SELECT doc_id, unnest([trim(x, ' ' || chr(9) || chr(10) || chr(13)) FOR x IN {SPLIT.format('text')}]) AS sentence FROM documents) SELECT doc_id, count(*) AS n, max(length(sentence))::BIGINT AS longest FROM s WHERE sentence <> '' GROUP BY doc_id")
def split_sentences(spark, d):
    s = S.documents(spark, d).select("doc_id", F.explode(T.sentences("text")).alias("sentence"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


@query("r33_concepts", "SELECT doc_id, unnest(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '(?i)\\b(version \\d+(?:\\.\\d+)?|license)\\b', 1)])) AS concept FROM documents")
def extract_concepts(spark, d):
    return S.documents(spark, d).select("doc_id", F.explode(T.concepts("text", r"(?i)\b(version \d+(?:\.\d+)?|license)\b")).alias("concept"))


@query("r34_token_count", "SELECT conv_id, greatest(1, sum(len([x FOR x IN string_split_regex(text, '\\s+') IF x <> '']))::BIGINT) AS n FROM conversations GROUP BY conv_id")
def token_count(spark, d):
    return S.table(spark, d, "conversations").groupBy("conv_id").agg(F.greatest(F.lit(1), F.sum(T.word_count("text"))).cast("long").alias("n"))


ANY_WORD = "regexp_extract(text, '[A-Za-z]{3,}')"


@query("r35_definition_targets", f"SELECT item_id, lower({ANY_WORD}) AS target, CASE WHEN length({ANY_WORD}) <= 6 THEN upper({ANY_WORD}) ELSE lower({ANY_WORD}) END AS label FROM benchmark")
def definition_targets(spark, d):
    """Whole passages that end with the question what their first word is."""
    q = F.concat("text", F.lit(". So, What  is "), F.regexp_extract("text", "[A-Za-z]{3,}", 0), F.lit("?"))
    return S.table(spark, d, "benchmark").select("item_id", T.definition_object(q).alias("target"), T.definition_label(q).alias("label"))


W1 = "lower(regexp_extract(text, '[A-Za-z]{5,}'))"


@query("r36_type_targets", f"SELECT item_id, CASE WHEN w IN ('there', 'types', 'kinds') THEN '' ELSE {CANON.format('w')} END AS targets FROM (SELECT item_id, {W1} AS w FROM benchmark)")
def type_targets(spark, d):
    """Whole passages that end with a question for the kinds of one of their words."""
    q = F.concat("text", F.lit(". Kinds of "), F.regexp_extract("text", "[A-Za-z]{5,}", 0), F.lit("?"))
    return S.table(spark, d, "benchmark").withColumn("q", T.normalize_for_match(q)).select("item_id", F.array_join(T.type_targets(F.col("q")), " ").alias("targets"))


PII_SQL = "\nUNION ALL ".join(f"SELECT doc_id, '{e}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS v FROM documents" for e, p in (("EMAIL_ADDRESS", EMAIL), ("US_SSN", SSN), ("PHONE_NUMBER", PHONE)))


@query("r37_detect_pii", f"SELECT doc_id, entity_type, count(*) AS n, sum(length(v))::BIGINT AS chars FROM ({PII_SQL}) GROUP BY ALL")
def detect_pii(spark, d):
    e = C.detect_pii(S.documents(spark, d))
    return e.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.sum(F.col("end_offset") - F.col("start_offset")).cast("long").alias("chars"))


@query(
    "r09_list_pii",
    "WITH RECURSIVE m AS (SELECT doc_id, entity_type, v, row_number() OVER () AS n FROM (" + PII_SQL + ")), k AS (SELECT doc_id, entity_type, list(v ORDER BY n) AS vs FROM m GROUP BY ALL), r AS (SELECT k.doc_id, entity_type, vs, 1 AS i, 0 AS off, d.text FROM k JOIN documents d USING (doc_id) UNION ALL SELECT doc_id, entity_type, vs, i + 1, off + instr(substr(text, off + 1), vs[i]) - 1 + length(vs[i]), text FROM r WHERE i <= len(vs)) SELECT doc_id, entity_type, (off - length(vs[i - 1]))::INTEGER AS start_offset, off::INTEGER AS end_offset FROM r WHERE i > 1",
)
def list_pii(spark, d):
    """Every entity of every document with its place."""
    return C.detect_pii(S.documents(spark, d)).orderBy("doc_id", "start_offset").select("doc_id", "entity_type", "start_offset", "end_offset")


@query("r38_redact_pii", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g'), '{SSN}', '<SSN>', 'g'), '{PHONE}', '<PHONE>', 'g') AS text FROM documents")
def redact_pii(spark, d):
    return C.redact_pii(S.documents(spark, d)).select("doc_id", "text")


@query("r39_pii_rollup", f"SELECT d.source AS tenant_id, e.entity_type, count(*) AS n FROM documents d JOIN ({PII_SQL}) e USING (doc_id) GROUP BY ROLLUP (d.source, e.entity_type)")
def pii_rollup(spark, d):
    docs = S.documents(spark, d)
    e = C.detect_pii(docs).join(docs.select("doc_id", "tenant_id"), "doc_id")
    return e.rollup("tenant_id", "entity_type").agg(F.count("*").alias("n"))
