"""Blocks of queries against shards of candidates, for the two exhaustive vector searches.

Queries are dealt to blocks of a bounded size in bytes (their vectors and what is kept of their best candidates) and
candidates to shards; a cell is one block and one shard. A task reads a cell sorted: first the block's queries, then the
shard's candidates as a stream, so it holds one block and one batch. Each candidate is copied to every block, so blocks
are as large as a task's memory allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a block, and of one kept candidate of one query; candidates of a shard, the least number of shards, and candidates compared at a time.
BLOCK_BYTES, KEPT_BYTES, SHARD, SHARDS, ROWS = 128 << 20, 144, 250_000, 8, 2048


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and `v` (array of double) of rows whose vector has only finite components (and, on demand, one that is not 0)."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    if nonzero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def cells_of(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Rows (cell, tag, vec_id, v) partitioned and sorted by cell; tag 0: a query, 1: a candidate. Vectors meet those of their own size only."""
    n = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    block_rows = max(1, BLOCK_BYTES // (8 * n["d"] + KEPT_BYTES * k))
    blocks, shards = max(1, -(-n["q"] // block_rows)), max(SHARDS, -(-n["n"] // SHARD))
    asked = rows.where(is_query).distinct()
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(shards)).cast("int")
    left = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), block.alias("b"), F.lit(0).alias("tag"), "vec_id", "v")
    right = rows.select(shard.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("tag"), "vec_id", "v")
    cells = left.unionByName(right).select(F.struct(F.size("v").alias("d"), "b", "s").alias("at"), "tag", "vec_id", "v")
    partitions = min(blocks * shards, 100_000)
    keyed = cells.select(F.xxhash64("at.d", "at.b", "at.s").alias("cell"), "tag", "vec_id", "v")
    return keyed.repartition(partitions, "cell").sortWithinPartitions("cell", "tag", "vec_id")


def stream(search: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """search(ids, queries) makes an object with add(ids, candidates) and rows() -> arrays (query number, candidate id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, state, held = None, None, []

        def ready():
            return search(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        def rows(state):
            n, ids, scores = state.rows()
            text = [state.queries[i].tobytes() for i in range(len(state.ids))]
            key = pa.array(np.array([hash_of(t) for t in text], dtype=np.int64)[n] if len(n) else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(state.ids[n]), key, pa.array(ids), pa.array(scores)], names=["query_id", "query_key", "vec_id", "score"])

        for b in batches:
            cells, tags, ids = (b.column(c).to_numpy() for c in ("cell", "tag", "vec_id"))
            lists = b.column("v")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            change = np.flatnonzero((cells[1:] != cells[:-1]) | (tags[1:] != tags[:-1])) + 1
            for at, end in zip([0, *change.tolist()], [*change.tolist(), len(cells)]):
                if cells[at] != cell:
                    if state is not None:
                        yield rows(state)
                    cell, state, held = cells[at], None, []
                part = flat[offsets[at] : offsets[end]].reshape(end - at, -1)
                if tags[at] == 0:
                    held.append((ids[at:end], part))
                elif held:
                    if state is None:
                        state = ready()
                    for k in range(0, end - at, ROWS):
                        state.add(ids[at + k : min(end, at + k + ROWS)], part[k : k + ROWS])
        if state is not None:
            yield rows(state)

    return run


def hash_of(raw: bytes) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(raw)).view(np.int64))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the cells found for each query: query_id, rank, vec_id, score."""
    w = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
