"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_TABLES: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder. Where none is named, a local session (tests) gets one of its own; elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        _OWN[app] = tempfile.mkdtemp(prefix="attesta-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: the lineage ends there.

    The table stays until release(), the end of temporaries() or the end of the driver's process.
    """
    spark = df.sparkSession
    path = place(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):  # shuffled rows go when the table is there
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, name: str = "few", limit: int = 200_000) -> DataFrame:
    """df as cut(); sent whole to all tasks where it is joined if it has at most `limit` rows, so that the larger side is not moved. Longer ones are joined as Spark sees fit."""
    written = cut(df, name)
    return F.broadcast(written) if written.count() <= limit else written


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for files that others write; it goes when the tables of cut() do."""
    path, app = f"{folder(spark)}/attesta/{uuid.uuid4().hex}/{name}", spark.sparkContext.applicationId
    if app not in _TABLES:
        atexit.register(_release_all, spark, app)
    _TABLES.setdefault(app, []).append(path)
    return path


def last_table(spark: SparkSession) -> str:
    """The path of the table that cut() wrote last."""
    return _TABLES[spark.sparkContext.applicationId][-1]


def release(spark: SparkSession, tables: list[str] | None = None) -> None:
    """Delete the named intermediate tables, or all of this application."""
    made = _TABLES.get(spark.sparkContext.applicationId, [])
    for path in list(made if tables is None else tables):
        delete(spark, path.rpartition("/")[0])
        if path in made:
            made.remove(path)


def _release_all(spark: SparkSession, app: str) -> None:
    """At the end of the process: what is left of the tables, as far as the session still runs, and the folder of our own."""
    if spark.sparkContext._jsc is not None:
        with suppress(Exception):  # the JVM may have ended before
            release(spark)
    if app in _OWN:
        shutil.rmtree(_OWN[app], ignore_errors=True)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Of the tables written inside, all but the last are deleted at the end."""
    made = lambda: _TABLES.get(spark.sparkContext.applicationId, [])
    before = set(made())
    try:
        yield
    finally:
        release(spark, [p for p in made() if p not in before][:-1])


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    files, at = _at(spark, path)
    opened = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder."""
    files, at = _at(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()]


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
