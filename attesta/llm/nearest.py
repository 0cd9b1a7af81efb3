"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

In a cell (a block of queries, a shard of candidates) each vector is scaled to int8. A tile's products are exact
integers; scaled back they are the inner product up to |ex| |y| + |x'| |ey| (ex, ey: the quantisation errors, x' the
scaled-back query). Only pairs whose upper bound reaches the query's k-th best so far are recomputed, in double precision
and component by component, and pushed to the query's heap. A bound that is no finite number bounds nothing. The result is exact: nothing that could be among the k best is left out.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of different
sizes do not meet; a query's own id is no candidate; repeated query rows count once, repeated candidate rows each; ties
go to smaller ids; products beyond the range of doubles are infinite, and sums of such of both signs count as the least;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._blocks import best, cells_of, stream, usable
from attesta.llm._common import prepare

QUERIES = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of what they stand for, of the errors, and of the rows themselves.

    Norms are taken of rows scaled to 127, so that no square leaves the range of doubles.
    """
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    scaled = x / scale[:, None]
    small = np.clip(np.rint(scaled), -127, 127).astype(np.int8)
    return small, scale, scale * np.linalg.norm(small.astype(float), axis=1), scale * np.linalg.norm(scaled - small, axis=1), scale * np.linalg.norm(scaled, axis=1)


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows, added up from the first component to the last."""
    out = np.zeros(len(x))
    for t in range(x.shape[1]):
        out += x[:, t] * y[:, t]
    return np.where(np.isnan(out), -np.inf, out)


class Tiles:
    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.q, self.scale, self.back, self.error, _ = quantised(queries)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.bar = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, candidates: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self.compare(ids, candidates)

    def compare(self, ids: np.ndarray, candidates: np.ndarray) -> None:
        c, scale, _, error, norm = quantised(candidates)
        for at in range(0, len(self.ids), QUERIES):
            part = slice(at, at + QUERIES)
            # products of int8 sum below 2^24 for up to 1040 dimensions, so float32 holds them exactly
            kind = np.float32 if c.shape[1] <= 1040 else np.float64
            about = (self.q[part].astype(kind) @ c.T.astype(kind)) * self.scale[part, None] * scale[None, :]
            slack = self.error[part, None] * norm[None, :] + self.back[part, None] * error[None, :]
            slack += 1e-9 * (np.abs(about) + slack) + 1e-300
            high, low = about + slack, about - slack
            bounded = np.isfinite(high) & np.isfinite(low)
            if not bounded.all():
                high, low = np.where(bounded, high, np.inf), np.where(bounded, low, -np.inf)
            own = self.ids[part, None] == ids[None, :]
            bar = self.bar[part]
            if about.shape[1] > self.k:
                low = np.where(own, -np.inf, low)
                bar = np.maximum(bar, np.partition(low, -self.k, axis=1)[:, -self.k])
            n, m = np.nonzero((high >= bar[:, None]) & ~own)
            for step in range(0, len(n), 65536):
                i, j = n[step : step + 65536], m[step : step + 65536]
                exact = inner(self.queries[at + i], candidates[j])
                ok = exact >= self.bar[at + i]
                for q, s, x in zip((at + i[ok]).tolist(), exact[ok].tolist(), ids[j[ok]].tolist()):
                    heap = self.heaps[q]
                    if len(heap) < self.k:
                        heapq.heappush(heap, (s, -x))
                    elif (s, -x) > heap[0]:
                        heapq.heapreplace(heap, (s, -x))
                        self.bar[q] = heap[0][0]
            for q in range(at, min(at + QUERIES, len(self.ids))):
                if len(self.heaps[q]) == self.k:
                    self.bar[q] = self.heaps[q][0][0]

    def rows(self):
        n = np.repeat(np.arange(len(self.ids)), [len(h) for h in self.heaps])
        pairs = [p for h in self.heaps for p in sorted(h, reverse=True)]
        return n, np.array([-p[1] for p in pairs], dtype=np.int64), np.array([p[0] for p in pairs], dtype=np.float64)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """vectors (vec_id, embedding, ...): for each id divisible by `every`, its k largest inner products in double precision."""
    prepare(vectors.sparkSession)
    cells = cells_of(usable(vectors, nonzero=True), F.col("vec_id") % every == 0, k)
    found = cells.mapInArrow(stream(lambda ids, queries: Tiles(ids, queries, k)), "query_id long, query_key long, vec_id long, score double")
    return best(found, k)
