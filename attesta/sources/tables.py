"""Loading documents and the tables that stand for them in tests: tenant = source, matter = lang."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from attesta.functions import fixed
from attesta.functions.text import clean_text
from attesta.operators.chunks import chunk_id

SCOPE = ["tenant_id", "matter_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("matter_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit(None).cast("int").alias("page"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as questions, each asked in one scope (dealt by item_id)."""
    i = F.col("item_id")
    matter = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.floor(i / 20) % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(i.alias("question_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("tenant_id"), matter.alias("matter_id"), F.col("text").alias("question"))


@F.pandas_udf(StringType())
def decode_utf8(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def load_text(files: DataFrame) -> DataFrame:
    """files (doc_id, content binary): one row per text that is not blank, bad bytes replaced, page null."""
    rows = files.select("doc_id", F.lit(None).cast("int").alias("page"), decode_utf8("content").alias("text"))
    return rows.where(clean_text("text") != "")


def load_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return load_text(found.select(F.col("path").alias("doc_id"), "content"))


def load_paged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, pages array<string>): one row per page that is not blank, numbered from 1."""
    each = docs.select("doc_id", F.posexplode("pages").alias("pos", "text"))
    return each.where(clean_text("text") != "").select("doc_id", (F.col("pos") + 1).alias("page"), "text")


def metadata(files: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, what files have of filename, content_type and created_at, sha256 of the bytes, page_count (null if no page is numbered)."""
    count = pages.groupBy("doc_id").agg(F.max(F.coalesce("page", F.lit(0))).alias("m"))
    own = [c for c in ("filename", "content_type", "created_at") if c in files.columns]
    return files.select("doc_id", *own, F.sha2("content", 256).alias("sha256")).join(count, "doc_id", "left").select("doc_id", *own, "sha256", F.nullif(F.col("m"), F.lit(0)).alias("page_count"))


def admit(files: DataFrame, pages: DataFrame, max_bytes: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """files with `rejected`: null, or why the file is not taken."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    mb = max_bytes // (1024 * 1024)
    why = F.when(F.length("content") > max_bytes, F.lit(f"upload exceeds {mb} MB")).when(F.coalesce("n_pages", F.lit(0)) == 0, F.lit("document has no extractable text"))
    return files.join(n, "doc_id", "left").withColumn("rejected", why).select("doc_id", "rejected")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The union with one row per key, that of the highest version; a batch wins over the target at equal versions."""
    both = target.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def replace_by(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of batch take the place of all rows of target with their keys."""
    return target.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def manifest(files: DataFrame, licenses: DataFrame) -> DataFrame:
    """filename, source, sha256 and the license of the source. licenses has a row per source and must be small."""
    return files.join(licenses, "source", "left").select("filename", "source", F.sha2("content", 256).alias("sha256"), "license")


def write_scope_partitions(chunks: DataFrame, path: str) -> None:
    """Replace the scopes that chunks holds, and only those, in a table partitioned by tenant and matter."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "matter_id").parquet(path)


def upsert_chunks(table: DataFrame, chunks: DataFrame) -> DataFrame:
    """All that the scopes of chunks will hold: the table's chunks of other documents, and chunks.

    Rows without a doc_id replace nothing; their ordinals go on from those that the scope has without one.
    """
    same = lambda a, b: a["tenant_id"].eqNullSafe(b["tenant_id"]) & a["matter_id"].eqNullSafe(b["matter_id"])
    scopes, docs = chunks.select(*SCOPE).distinct(), chunks.select(*SCOPE, "doc_id").distinct()
    # Only equality prunes partitions; scopes with a null are looked up apart.
    held = table.join(scopes, SCOPE, "left_semi").unionByName(table.where("tenant_id IS NULL OR matter_id IS NULL").join(scopes, same(table, scopes), "left_semi"))
    others = held.join(docs, same(held, docs) & (held["doc_id"] == docs["doc_id"]), "left_anti")
    after = held.where("doc_id IS NULL").groupBy(*SCOPE).agg((F.max("ordinal") + 1).alias("after"))
    placed = chunks.join(after, same(chunks, after), "left").select(*(chunks[c] for c in chunks.columns), "after")
    moved = F.col("doc_id").isNull() & F.col("after").isNotNull()
    placed = placed.withColumn("ordinal", F.when(moved, F.col("ordinal") + F.col("after")).otherwise(F.col("ordinal")))
    placed = placed.withColumn("chunk_id", F.when(moved, chunk_id()).otherwise(F.col("chunk_id")))
    return others.unionByName(placed.select(*chunks.columns))


EVAL_RECORD = ["id", "context_id", "split", "question", "program_answer", "original_answer", "context", "file_name"]


def load_eval_records(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """JSON lines of several sources (name -> path): every field as text, a missing one empty, and the source's name."""
    schema = ", ".join(f"{c} string" for c in EVAL_RECORD)  # numbers are read as their text

    def one(name: str, path: str) -> DataFrame:
        rows = spark.read.schema(schema).json(path)
        return rows.select(F.lit(name).alias("source"), *(F.coalesce(c, F.lit("")).alias(c) for c in EVAL_RECORD))

    return reduce(DataFrame.unionByName, [one(name, path) for name, path in sources.items()])


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
