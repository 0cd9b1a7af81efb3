"""Streaming queries: the events table is read as a file stream and the result compared with the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators.index import Index
from attesta.plans.answers import ANSWERS, HYBRID, answered, attacked_fifth, hybrid_hits
from attesta.plans.records import CHAIN, payload
from attesta.plans.registry import query
from attesta.plans.retrieval import DIM, standing
from attesta.plans.texts import CHUNK, EMAIL, PHONE, SSN
from attesta.sources import scratch
from attesta.sources.versions import Versions
from attesta.streaming import streams as R


def place(spark):
    at = scratch.place(spark, "stream")
    return f"{at}/out", f"{at}/checkpoint"


def stream(spark, d, name):
    """A table as a stream of its files."""
    at = f"{d}/{name}.parquet"
    schema = spark.read.parquet(at).schema
    folder_, _, file = at.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder_}/{file}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def events(spark, d):
    e = stream(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tenant_id"), F.col("event_type").alias("actor"), "event_type", payload().alias("payload"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


@query("r93_append_chain_stream", f"{CHAIN.replace('PARTITION BY tenant_id ORDER BY id', 'PARTITION BY tenant_id ORDER BY created_at, id')} SELECT id, tenant_id, previous_hash, event_hash FROM chain")
def append_chain_stream(spark, d):
    out, checkpoint = place(spark)
    store = Versions(spark, out)
    R.chain_stream(events(spark, d), store, checkpoint).awaitTermination()
    return store.read("events").select("id", "tenant_id", "previous_hash", "event_hash")


@query("r97_ingest_stream", "WITH " + CHUNK.replace("trim(regexp_replace(text, ", f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g'), '{SSN}', '<SSN>', 'g'), '{PHONE}', '<PHONE>', 'g'), ") + " SELECT chunk_id, doc_id, text FROM chunk")
def ingest_stream(spark, d):
    out, checkpoint = place(spark)
    pages = stream(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("matter_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(None).cast("int").alias("page"), "text")
    R.ingest_stream(pages, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("chunk_id", "doc_id", "text")


@query(
    "r97b_upload_stream",
    "WITH " + CHUNK.replace("trim(regexp_replace(text, ", f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g'), '{SSN}', '<SSN>', 'g'), '{PHONE}', '<PHONE>', 'g'), ")
    + f""", d AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS tenant_id, any_value(lang) AS matter_id FROM documents GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1),
x AS (SELECT d.*, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AS good FROM d)
SELECT x.doc_id, x.tenant_id, CASE WHEN good THEN sha256(x.text) END AS sha256, CASE WHEN good THEN coalesce(n, 0) END AS chunk_count, CASE WHEN NOT good THEN 'document has no extractable text' END AS reason, count(DISTINCT c.chunk_id) AS indexed FROM x LEFT JOIN n USING (doc_id) LEFT JOIN chunk c USING (doc_id) GROUP BY ALL""",
)
def upload_stream(spark, d):
    """The documents as uploaded files: what became of each one, and how many of its chunks the index has."""
    out, checkpoint = place(spark)
    index = Index(Versions(spark, out), DIM, "md5")
    files = stream(spark, d, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("matter_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("content_type"), F.encode("text", "UTF-8").alias("content"))
    R.upload_stream(files, index, checkpoint).awaitTermination()
    good = index.store.read("documents").select("doc_id", "tenant_id", "sha256", "chunk_count", F.lit(None).cast("string").alias("reason"))
    bad = index.store.read("rejections").select("doc_id", "tenant_id", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("chunk_count"), "reason")
    held = index.chunks().groupBy("doc_id").agg(F.count("*").alias("indexed"))
    return good.unionByName(bad).join(held, "doc_id", "left").fillna(0, ["indexed"])


@query("r98_answer_stream", f"WITH {HYBRID} {ANSWERS}")
def answer_stream(spark, d):
    out, checkpoint = place(spark)
    standing(spark, d)  # whole before the stream starts, so that batches only read it

    def answer(batch):
        asked = scratch.cut(batch)
        return answered(attacked_fifth(asked), hybrid_hits(spark, d, asked)[1])

    i = F.col("item_id")
    matter = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.floor(i / 20) % 4 + 1).cast("int"))
    q = stream(spark, d, "benchmark").select(i.alias("question_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("tenant_id"), matter.alias("matter_id"), F.col("text").alias("question"))
    R.answer_stream(q, answer, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("question_id", "status", "answer", F.get(F.flatten(F.transform("claims", lambda c: c["citations"])), 0)["chunk_id"].alias("cited"))


@query("r99_rates_stream", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def rates_stream(spark, d):
    out, checkpoint = place(spark)
    R.run_to_table(R.rates_stream(stream(spark, d, "events"), "event_type"), out, checkpoint, "update")
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).groupBy("window_start", "event_type").agg(F.max("n").alias("n"))


@query("r99b_sliding_rates_stream", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE AS window_start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL")
def sliding_rates_stream(spark, d):
    out, checkpoint = place(spark)
    R.run_to_table(R.rates_stream(stream(spark, d, "events"), "event_type", 15, slide=5), out, checkpoint, "update")
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).groupBy("window_start", "event_type").agg(F.max("n").alias("n"))


@query("r100_alert_stream", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS failures FROM events WHERE value > 90 GROUP BY ALL")
def alert_stream(spark, d):
    out, checkpoint = place(spark)
    R.run_to_table(R.alert_stream(stream(spark, d, "events"), F.col("value") > 90), out, checkpoint, "update")
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).groupBy("window_start").agg(F.max("failures").alias("failures"))
