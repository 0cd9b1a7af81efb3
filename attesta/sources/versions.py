"""Several tables in one folder that change together, version by version.

A version is written beside the others and becomes visible by one rename of the file CURRENT, so a reader sees whole
versions only, and a writer that fails leaves the last one as it was. Tables are kept in partitions, one for each scope;
a version holds only the partitions that it touches. The manifest of a version names for each table and scope the
versions whose files count: one, where a version replaced the scope, or several, where versions were added to it.

Writers of a stream give their name and the number of their batch, which are kept with the version: a batch that
runs again after its version became visible changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from attesta.sources.scratch import cut, delete, exists, folders, read_text, setting
from attesta.sources.tables import upsert

MANIFEST = "name string, scope_key string, version int"


def scope_key(*columns: str) -> Column:
    """A name for the values of some columns (nulls too) that can stand in a path."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.md5(F.col(c).cast("string"))), F.lit("null"))
    return F.concat(F.lit("s"), F.md5(F.concat_ws("|", *(part(c) for c in columns))))


@dataclass
class Change:
    """Rows (with scope_key) for a table. Their scopes, or `scopes` (scope_key) if given, lose what they had, or with `add` keep it.

    Instead of rows, a function makes them from what the same version has written of the tables before (name -> rows with scope_key).
    """

    rows: DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]
    add: bool = False
    scopes: DataFrame | None = None
    #: Whether the rows of a scope lie in few partitions already.
    placed: bool = False


@dataclass
class Versions:
    spark: SparkSession
    root: str
    schemas: dict[str, StructType] = field(default_factory=dict)

    def state(self) -> dict:
        """version (0: none yet), batches (writer -> number of its last batch) and the schemas of the tables."""
        at = f"{self.root}/CURRENT"
        if not exists(self.spark, at):
            return {"version": 0, "batches": {}, "schemas": {}}
        return json.loads(read_text(self.spark, at))

    def _manifest(self, version: int) -> DataFrame:
        if version == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table's rows with scope_key and version, of the current version or of an older one that is still kept."""
        state = self.state()
        version = state["version"] if version is None else version
        schema = StructType.fromJson(state["schemas"][name])
        files = StructType([*schema.fields, StructField("version", IntegerType()), StructField("scope_key", StringType())])
        live = self._manifest(version).where(F.col("name") == name).select("scope_key", "version")
        # Both are partition columns: only the folders of live versions are read.
        rows = self.spark.read.schema(files).parquet(f"{self.root}/tables/{name}")
        return rows.join(live, ["scope_key", "version"]).select(*schema.fieldNames(), "scope_key", "version")

    def commit(self, changes: Mapping[str, Change], writer: str | None = None, batch: int | None = None) -> int:
        """Write a new version and make it the current one; the number of the version."""
        state = self.state()
        if writer is not None and state["batches"].get(writer, -1) >= batch:
            return state["version"]
        old, new = state["version"], state["version"] + 1
        manifest = self._manifest(old)

        def fresh(name: str) -> DataFrame:
            schema = StructType([*StructType.fromJson(state["schemas"][name]).fields, StructField("scope_key", StringType())])
            return self.spark.read.schema(schema).parquet(f"{self.root}/tables/{name}/version={new}")

        for name, change in changes.items():
            made = change.rows(fresh) if callable(change.rows) else change.rows
            columns = [c for c in made.columns if c not in ("scope_key", "version")]
            at = f"{self.root}/tables/{name}/version={new}"
            # Rows of a scope go to few files; a large scope is split by adaptive execution.
            rows = made.select(*columns, "scope_key")
            # Where a partition has few scopes already, their files are written side by side, and rows are not sorted by scope first.
            with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", "16" if change.placed else "0"):
                (rows if change.placed else rows.hint("rebalance", "scope_key")).write.mode("overwrite").partitionBy("scope_key").parquet(at)
            state["schemas"][name] = json.loads(made.select(*columns).schema.json())
            written = self._written(at)
            if not change.add:
                touched = written.select("scope_key") if change.scopes is None else change.scopes.select("scope_key").distinct()
                kept = manifest.where(F.col("name") == name).join(touched, "scope_key", "left_anti")
                manifest = manifest.where(F.col("name") != name).unionByName(kept)
            manifest = manifest.unionByName(written.select(F.lit(name).alias("name"), "scope_key", F.lit(new).alias("version")))
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/{new}")
        if writer is not None:
            state["batches"][writer] = batch
        self._publish({**state, "version": new})
        return new

    def _written(self, at: str) -> DataFrame:
        """The scopes of which a version has files, from the names of its folders."""
        keys = [(n.partition("=")[2],) for n in folders(self.spark, at) if n.startswith("scope_key=")]
        return self.spark.createDataFrame(keys, "scope_key string")

    def _publish(self, state: dict) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        beside, current = path(f"{self.root}/.CURRENT-{state['version']}"), path(f"{self.root}/CURRENT")
        out = beside.getFileSystem(conf).create(beside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf).rename(beside, current, options)

    def vacuum(self) -> list[str]:
        """Delete the files that the current version does not need, and all older manifests; the deleted folders."""
        state = self.state()
        live = {(r["name"], r["version"]) for r in self._manifest(state["version"]).select("name", "version").distinct().collect()}  # a few versions
        gone = [f"{self.root}/tables/{n}/version={v}" for n in state["schemas"] for v in range(1, state["version"] + 1) if (n, v) not in live]
        gone += [f"{self.root}/manifests/{v}" for v in range(1, state["version"])]
        gone = [p for p in gone if exists(self.spark, p)]
        for p in gone:
            delete(self.spark, p)
        return gone


def upsert_rows(table: Versions, name: str, batch: DataFrame, keys: list[str], version: str, writer: str | None = None, number: int | None = None) -> int:
    """One row for each key (batch with scope_key): that of the highest `version` column, of equal ones the batch's. Only the scopes of the batch are read and written."""
    rows = cut(batch, "batch")
    held = rows.limit(0)
    if name in table.state()["schemas"]:
        held = table.read(name).join(rows.select("scope_key").distinct(), "scope_key", "left_semi").select(*rows.columns)
    return table.commit({name: Change(upsert(held, rows, keys, version))}, writer, number)
