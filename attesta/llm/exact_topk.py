"""Exact top-k search by exhaustive term-at-a-time accumulation.

Each dimension is a term. In a cell (a block of queries, a shard of candidates) the posting list of a term holds the
candidates with a weight other than 0 there; query rows scatter query weight times posting weights into dense score
arrays, term by term. Partition selection picks each array's k best, and the cells' lists are merged by a window.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0
against empty vectors; vectors of different sizes do not meet; a query's own id is no candidate; repeated query rows
count once; repeated candidate rows each count; scores beyond 64 bits are held at the ends of that range; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._blocks import best, cells_of, stream, usable
from attesta.llm._common import prepare

QUERIES = 512


class Accumulators:
    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, np.floor(queries * 64), k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(0, len(ids), QUERIES)]
        self.most = np.abs(self.queries).max(initial=0)

    def scores(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Term at a time: the score of each row of q with each row of c."""
        bound = self.most * np.abs(c).max(initial=0) * max(1, c.shape[1])
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object  # wide enough that every sum is exact
        if kind is object:
            q, c = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
        q, postings = q.astype(kind), np.ascontiguousarray(c.T.astype(kind))
        acc = np.zeros((len(q), c.shape[0]), dtype=kind)
        part = np.empty_like(acc)
        for t in range(c.shape[1]):
            asking, holding = np.flatnonzero(q[:, t] != 0), np.flatnonzero(postings[t] != 0)
            if 2 * len(asking) > len(q) and 2 * len(holding) > c.shape[0]:
                acc += np.multiply(q[:, t, None], postings[t][None, :], out=part)
            elif len(asking) and len(holding):
                acc[np.ix_(asking, holding)] += q[asking, t, None] * postings[t][holding][None, :]
        if kind is object:
            low, high = -(2**63), 2**63 - 1
            return np.array([[min(high, max(low, int(x))) for x in row] for row in acc], dtype=np.int64).reshape(acc.shape)
        return acc

    def add(self, ids: np.ndarray, candidates: np.ndarray) -> None:
        terms = np.floor(candidates * 64)
        for g, at in enumerate(range(0, len(self.ids), QUERIES)):
            for col in range(0, len(ids), 512):
                self.select(g, at, ids[col : col + 512], self.scores(self.queries[at : at + QUERIES], terms[col : col + 512]))

    def select(self, g: int, at: int, ids: np.ndarray, acc: np.ndarray) -> None:
        """Merge the best of acc into what group g has found; ties go to smaller ids."""
        own = self.ids[at : at + QUERIES, None] == ids[None, :]
        fq, fi, fs = self.found[g]
        bar = np.full(acc.shape[0], np.iinfo(np.int64).min)
        if len(fq):
            count = np.bincount(fq, minlength=acc.shape[0])
            last = np.cumsum(count) - 1
            bar = np.where(count >= self.k, fs[np.maximum(last, 0)], bar)
        good = (acc >= bar[:, None]) & ~own
        if acc.shape[1] > self.k and good.sum() > 2 * self.k * acc.shape[0]:
            masked = np.where(own, -np.inf, acc) if acc.dtype != np.int64 else np.where(own, np.iinfo(np.int64).min, acc)
            good &= masked >= np.partition(masked, acc.shape[1] - self.k - 1, axis=1)[:, -self.k - 1, None]
        q, c = np.nonzero(good)
        if not len(q):
            return
        q, i, s = np.concatenate([fq, q]), np.concatenate([fi, ids[c]]), np.concatenate([fs, acc[q, c].astype(np.int64)])
        order = np.lexsort((i, -s.astype(object) if len(s) and s.min() == np.iinfo(np.int64).min else -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, q, side="left")
        top = np.arange(len(q)) - first < self.k
        self.found[g] = (q[top], i[top], s[top])

    def rows(self):
        return tuple(np.concatenate([f[k] + (g * QUERIES if k == 0 else 0) for g, f in enumerate(self.found)]) for k in range(3))


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """vectors (vec_id, embedding, ...): for each id divisible by `every`, its k highest integer inner products."""
    prepare(vectors.sparkSession)
    cells = cells_of(usable(vectors, nonzero=False), F.col("vec_id") % every == 0, k)
    found = cells.mapInArrow(stream(lambda ids, queries: Accumulators(ids, queries, k)), "query_id long, query_key long, vec_id long, score long")
    return best(found, k)
