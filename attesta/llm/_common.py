"""What the operators of this subpackage share: intermediate tables, batches, keys and code shipping."""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.sources.scratch import cut as materialize  # noqa: F401  (the operators take it from here)

#: Rows in one Arrow batch handed to Python; texts can be long, so batches stay small.
BATCH_ROWS = 512
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make this package importable in the Python workers, wherever the driver was started."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parents[2]
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted((root / "attesta").rglob("*.py")):
                z.write(p, p.relative_to(root))
        folder = tempfile.mkdtemp(prefix="attesta-code-")
        target = os.path.join(os.path.realpath(folder), "attesta_code.zip")
        Path(target).write_bytes(packed.getvalue())
        spark.sparkContext.addPyFile(target)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bucket5(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5; rows with 0 are held out of every training. A null id counts as 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(1))


def held_out(doc_id: Column) -> Column:
    return bucket5(doc_id) == 0


def carried(docs: DataFrame) -> Column:
    """All columns of docs but the text, as one column `rest` that goes through scoring with its row."""
    return F.struct(*(c for c in docs.columns if c != "text")).alias("rest")


def restored(scored: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of docs from text and `rest`."""
    return scored.select(*((F.col("text") if c == "text" else F.col("rest")[c]).alias(c) for c in columns))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled rows (doc_id, label, text, ...) of docs outside the held-out fold, chosen by a hash of the id.

    An id labelled more than once takes its largest label, an id with several rows that of the smallest text (and of
    equal texts any, as a whole row); null ids and labels are left out.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.where(~held_out(F.col("doc_id"))).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct("text", *rest)).alias("row"))
    return one.select("doc_id", "label", "row.*")


def pieces(data: bytes, breaks: re.Pattern, size: int = 1 << 22) -> Iterator[bytes]:
    """data cut behind bytes that `breaks` matches, into pieces of about `size`, so that a very long text is never a list of all its words."""
    at = 0
    while len(data) - at > size:
        end = breaks.search(data, at + size)
        if end is None:
            break
        yield data[at : end.end()]
        at = end.end()
    yield data[at:] if at else data


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, sizes: DataFrame | None = None) -> DataFrame:
    """rows, left-joined with lookup (at most one row for each key); rows without a key meet nothing.

    A key with more rows than a task's share is joined by broadcast: there are fewer such keys than shuffle partitions, so
    what is broadcast is bounded, and no task gets all rows of such a key. sizes (key, n): keys with their number of
    rows, if known; keys that hold one row may be missing. rows are read several times, so give a written table.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-rows.count() // partitions))
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")) if sizes is None else sizes
    hot = materialize(sizes.where(F.col(key).isNotNull() & (F.col("n") > share)).select(key), "hot_keys")
    columns = [c for c in lookup.columns if c != key]
    out = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(lookup, key, "left")
    heavy = rows.join(F.broadcast(hot.join(lookup, key, "left")), key)
    bare = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(lookup.schema[c].dataType).alias(c) for c in columns))
    names = [*rows.columns, *columns]
    return out.select(*names).unionByName(heavy.select(*names)).unionByName(bare.select(*names))
