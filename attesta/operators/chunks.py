"""Chunks, personal data and tokens of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import fixed
from attesta.functions.text import clean_text, match_spans


def chunk_pages(pages: DataFrame, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """pages (doc_id, tenant_id, matter_id, filename, page, text) cut into windows of `size` characters; ordinals run through a document.

    A null or blank text has no chunks; repeated rows are cut each and share the document's ordinals.
    """
    stride = max(1, size - overlap)
    numbers = lambda t: F.sequence(F.lit(0), F.ceil(F.greatest(F.length(t) - size, F.lit(0)) / stride).cast("int"))
    windows = lambda t: F.transform(numbers(t), lambda i: F.trim(F.substring(t, i * stride + 1, F.lit(size))))
    # transform() of one value names it: the text is cleaned once, and no filter of it is moved below.
    each = F.get(F.transform(F.array(clean_text("text")), windows), 0)
    cut = pages.select("doc_id", "tenant_id", "matter_id", "filename", "page", F.posexplode(each).alias("pos", "text")).where("text <> ''")
    order = Window.partitionBy("tenant_id", "matter_id", "doc_id").orderBy("page", "pos")
    numbered = cut.withColumn("ordinal", F.row_number().over(order) - 1)
    return numbered.select(chunk_id().alias("chunk_id"), "tenant_id", "matter_id", "doc_id", "filename", "page", "ordinal", "text")


def chunk_id() -> Column:
    return F.sha2(F.concat_ws("|", "tenant_id", "matter_id", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")), 256)


def detect_pii(pages: DataFrame) -> DataFrame:
    """One row per entity: doc_id, entity_type, page, start_offset, end_offset, replacement. The value itself is not kept."""
    def entities(entity: str, pattern: str, mark: str) -> Column:
        return F.transform(match_spans("text", pattern), lambda s: F.struct(F.lit(entity).alias("entity_type"), s["start"].alias("start_offset"), s["end"].alias("end_offset"), F.lit(mark).alias("replacement")))

    found = F.concat(*(entities(e, p, mark) for e, (p, mark) in fixed.PII.items()))
    return pages.select("doc_id", "page", F.explode(found).alias("e")).select("doc_id", "e.entity_type", "page", "e.start_offset", "e.end_offset", "e.replacement")


def redact_pii(pages: DataFrame) -> DataFrame:
    """E-mail addresses first, so that a number inside one is not cut out of it."""
    text = F.col("text")
    for pattern, mark in fixed.PII.values():
        text = F.regexp_replace(text, pattern, mark)
    return pages.withColumn("text", text)
