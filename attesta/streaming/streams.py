"""The same work over streams: chains, uploads, answers, rates and alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from attesta.operators.audit import EVENT, append_chain
from attesta.operators.chunks import chunk_pages, detect_pii, redact_pii
from attesta.operators.index import Index
from attesta.sources.scratch import cut, delete, exists
from attesta.sources.tables import SCOPE, admit, load_text, metadata, upsert_chunks, write_scope_partitions
from attesta.sources.versions import Change, Versions, scope_key


def take_events(batch: DataFrame, number: int, store: Versions, chain: str = "tenant_id", redact: bool = True, writer: str = "events", parts: int = 64) -> int:
    """One batch of events, each redacted and linked to its chain's last hash, as one version of the tables `events` (with their place in the chain) and `tails` (chain, tail, length).

    A batch's events are linked in the order of created_at and id; late ones are appended as they arrive. A task reads its
    chains sorted, batch by batch of rows, and holds one hash, however many events a chain has. Chains are kept in
    `parts` partitions; a batch reads and writes the tails of those that it touches.
    """
    state = store.state()
    if state["batches"].get(writer, -1) >= number:
        return state["version"]
    part = F.format_string("p%05d", F.pmod(F.xxhash64(F.col(chain)), F.lit(parts))).alias("scope_key")
    events = cut(batch.select(*EVENT), "events")
    tails = batch.sparkSession.createDataFrame([], StructType([batch.schema[chain], *(StructField(n, t) for n, t in (("tail", StringType()), ("length", LongType()), ("scope_key", StringType())))]))
    if "tails" in state["schemas"]:
        tails = store.read("tails").join(events.select(part).distinct(), "scope_key", "left_semi").select(*tails.columns)
    chained = cut(append_chain(events, chain, redact, tails, ("created_at", "id")).select("*", part), "chained")
    last = chained.groupBy(chain, "scope_key").agg(F.max_by("event_hash", "place").alias("tail"), F.max("place").alias("length"))
    both = tails.withColumn("new", F.lit(0)).unionByName(last.withColumn("new", F.lit(1)))
    now = both.groupBy(chain, "scope_key").agg(F.max_by(F.struct("tail", "length"), "new").alias("x")).select(chain, "scope_key", "x.*")
    return store.commit({"events": Change(chained, add=True), "tails": Change(now)}, writer, number)


def chain_stream(events: DataFrame, store: Versions, checkpoint: str, chain: str = "tenant_id", redact: bool = True) -> StreamingQuery:
    """Events are appended to their chains batch by batch, each batch as one version; one that runs again changes nothing."""
    return events.writeStream.foreachBatch(lambda batch, n: take_events(batch, n, store, chain, redact) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates_stream(events: DataFrame, by: str, minutes: int = 5, late: str = "10 minutes", slide: int | None = None) -> DataFrame:
    """Counts by window, tumbling or (with a slide of so many minutes) sliding; rows later than the watermark are dropped."""
    w = F.window("ts", f"{minutes} minutes", f"{slide or minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n", (F.col("n") / (minutes * 60)).alias("rate"))


def alert_stream(events: DataFrame, failed: Column, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Windows with failures, as they come."""
    w = F.window("ts", f"{minutes} minutes")
    return events.where(failed).withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("failures")).select(F.col("w.start").alias("window_start"), "failures")


def ingest_stream(pages: DataFrame, chunks_path: str, checkpoint: str) -> StreamingQuery:
    """Pages are redacted, cut into chunks and upserted batch by batch into scope partitions.

    A document that comes again takes the place of its former chunks in its scope, so all its pages must come in one
    batch; one without text changes nothing. What the touched scopes will hold is first written whole beside the
    checkpoint, under the batch's number: a batch that runs again, even after a failure amid the partitions, writes the same.
    """

    def take(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        chunks = chunk_pages(redact_pii(batch)).withColumns({c: F.nullif(F.col(c), F.lit("")) for c in SCOPE})  # as partitions keep them
        merged = f"{checkpoint}/merged/{n}"
        if not exists(spark, f"{merged}/_SUCCESS"):
            whole = upsert_chunks(spark.read.schema(chunks.schema).parquet(chunks_path), cut(chunks, "chunks")) if exists(spark, chunks_path) else chunks
            whole.write.mode("overwrite").parquet(merged)
        write_scope_partitions(spark.read.schema(chunks.schema).parquet(merged), chunks_path)
        delete(spark, f"{checkpoint}/merged/{n - 1}")

    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replaced(index: Index, name: str, rows: DataFrame, docs: DataFrame, scopes: DataFrame) -> Change:
    """rows (with scope_key and doc_id) take the place of what the table held of docs (scope_key, doc_id); only the scopes are read and written."""
    if name in index.store.state()["schemas"]:
        held = index.store.read(name).join(scopes, "scope_key", "left_semi").select(*rows.columns)
        rows = held.join(docs, ["scope_key", "doc_id"], "left_anti").unionByName(rows)
    return Change(rows, scopes=scopes)


def take_uploads(batch: DataFrame, number: int, index: Index, extract: Callable[[DataFrame], DataFrame] = load_text, writer: str = "uploads") -> int:
    """One batch of uploads (doc_id, scope, filename, content_type, content, perhaps created_at) into all tables of the index, as one version.

    Rejected files go to `rejections`; of the others, the document, its personal data (offsets, no values) and its
    redacted chunks take the place of what its scope had under its doc_id, in `documents`, `pii` and the index. Of several
    files of a document in a batch that with the largest hash counts; files without a doc_id are documents of their
    own. extract: pages (doc_id, page, text) of files (doc_id, content, ...); by default each is a text.
    """
    spark = batch.sparkSession
    if index.store.state()["batches"].get(writer, -1) >= number:
        return index.store.state()["version"]
    keyed = batch.withColumn("scope_key", scope_key(*SCOPE)).withColumn("sha256", F.sha2("content", 256))
    one = F.row_number().over(Window.partitionBy("scope_key", "doc_id").orderBy(F.desc("sha256"), "filename"))
    files = keyed.withColumn("n", one).where("n = 1 OR doc_id IS NULL").drop("n", "sha256").withColumn("file", F.expr("uuid()"))
    files = cut(files, "files")
    named = files.drop("doc_id").withColumnRenamed("file", "doc_id")
    pages = cut(extract(named.select("doc_id", "content", "content_type", "filename")).select("doc_id", "page", "text"), "pages")
    checked = cut(admit(named, pages), "checked")
    taken = files.join(checked.where("rejected IS NULL").select(F.col("doc_id").alias("file")), "file", "left_semi")
    info = metadata(named, pages).withColumnRenamed("doc_id", "file").select("file", "sha256", "page_count")
    found = cut(detect_pii(pages).withColumnRenamed("doc_id", "file"), "pii")
    ids = cut(taken.drop("content"), "taken")
    texts = redact_pii(pages.withColumnRenamed("doc_id", "file").join(ids, "file"))
    chunks = cut(chunk_pages(texts.select("doc_id", *SCOPE, "filename", "page", "text")), "chunks")
    counted = chunks.groupBy(scope_key(*SCOPE).alias("scope_key"), "doc_id").agg(F.count("*").alias("chunk_count"))
    entities = found.groupBy("file").agg(F.count("*").alias("pii_entities_redacted"))
    named_count = (ids["scope_key"] == counted["scope_key"]) & ids["doc_id"].eqNullSafe(counted["doc_id"])
    documents = ids.join(info, "file", "left").join(entities, "file", "left").join(counted, named_count, "left").select(ids["scope_key"], ids["doc_id"], *(ids[c] for c in ids.columns if c not in ("scope_key", "doc_id", "file")), "sha256", "page_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("pii_entities_redacted", F.lit(0)).alias("pii_entities_redacted"))
    pii = found.join(ids.select("file", "scope_key", "doc_id", *SCOPE), "file").drop("file")
    docs, scopes = cut(ids.select("scope_key", "doc_id").where("doc_id IS NOT NULL").distinct(), "docs"), ids.select("scope_key").distinct()
    bad = checked.where("rejected IS NOT NULL").select(F.col("doc_id").alias("file"), F.col("rejected").alias("reason"))
    rejections = files.drop("content").join(bad, "file").drop("file")
    also = {"documents": replaced(index, "documents", cut(documents, "documents"), docs, scopes), "pii": replaced(index, "pii", cut(pii, "pii_rows"), docs, scopes), "rejections": Change(rejections, add=True)}
    removed = ids.select("doc_id", *SCOPE)
    return index.upsert(chunks, removed, writer, number, also)


def upload_stream(uploads: DataFrame, index: Index, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = load_text) -> StreamingQuery:
    """Uploads become documents, rejections, personal data, chunks and index, each batch as one version: all tables have it or none, and a batch that runs again changes nothing."""
    return uploads.writeStream.foreachBatch(lambda batch, n: take_uploads(batch, n, index, extract) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out_path: str, checkpoint: str) -> StreamingQuery:
    """Each batch of questions is answered by `answer` (questions -> answers) against the index tables."""

    def take(batch: DataFrame, n: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out_path}/batch={n}")

    return questions.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, written as Parquet."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
