"""Few questions against many chunks: one pass over the texts scores the chunks of a scope for all its questions.

The questions, with their words and the frequencies of these, are sent to all tasks. A batch of chunks has its words
counted once and scored for each question of its scope by products of arrays; only what can be among the best, and what
the graph starts from, leaves the task. So no word of a chunk is moved or written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from attesta.functions import fixed
from attesta.functions.text import concepts
from attesta.functions.words import counted, hashed

SCOPE = ["tenant_id", "matter_id"]
PLACE = ["chunk_id", "doc_id", "ordinal"]
DIGITS = 9
#: Numbers in an array of a task, and questions of a scope that are scored together.
CELLS, BLOCK = 4_000_000, 200


class Block:
    """Questions of one scope, as arrays: `ids` (rows of the asked table), `terms`, what a term counts for each question, and the hashed vectors."""

    def __init__(self, asked: pa.Table, rows: list[int], dim: int, mode: str):
        words = [asked["words"][r].as_py() or [] for r in rows]
        self.ids, self.avgdl = np.array(rows), asked["avgdl"][rows[0]].as_py() or 1.0
        self.terms = pa.array(sorted({w["term"] for each in words for w in each}), pa.string())
        number = {t: i for i, t in enumerate(self.terms.to_pylist())}
        idx, sign = hashed(self.terms.to_pylist(), dim, mode)
        self.times_idf, self.asks, self.vectors = np.zeros((len(number), len(rows))), np.zeros((len(number), len(rows))), np.zeros((dim, len(rows)))
        for q, each in enumerate(words):
            for w in each:
                t = number[w["term"]]
                self.times_idf[t, q], self.asks[t, q] = w["times"] * (w["idf"] or 0.0), 1 / len(each)
                self.vectors[idx[t], q] += w["times"] * sign[t]
        size = np.sqrt((self.vectors**2).sum(0))
        self.vectors /= np.where(size > 0, size, 1.0)

    def rows(self, dim: int, cells: int) -> int:
        """So many texts are scored together."""
        return max(1, cells // max(dim, len(self.terms), len(self.ids)))

    def scores(self, n: int, length: np.ndarray, row: np.ndarray, word: np.ndarray, tf: np.ndarray, words: pa.Array, hashes: tuple[np.ndarray, np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n texts (their lengths, and rows, words and frequencies of pairs): the dense and sparse scores, rounded, and the seeds."""
        idx, sign = hashes
        vectors = np.bincount(row * dim + idx[word], weights=tf * sign[word], minlength=n * dim).reshape(n, dim)
        size = np.sqrt((vectors**2).sum(1))[:, None]
        dense = (vectors @ self.vectors) / np.where(size > 0, size, 1.0)
        term = pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy()[word]
        mine = term >= 0
        found = np.zeros((n, len(self.terms)))
        found[row[mine], term[mine]] = tf[mine]
        norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * length / self.avgdl)[:, None]
        sparse = (found * (fixed.BM25_K1 + 1) / (found + norm)) @ self.times_idf
        return np.round(dense, DIGITS) + 0.0, np.round(sparse, DIGITS) + 0.0, (found > 0) @ self.asks


def best(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, of equal ones the first."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        mine = np.flatnonzero(score >= least)
        return mine[np.argsort(-score[mine], kind="stable")[:k]]
    return np.arange(len(score))


def scanned(asked: DataFrame, chunks: DataFrame, k: int, dim: int, mode: str, pattern: str | None, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """asked (question_id, scope, avgdl, words: array of term, times, idf), which must be few: the chunks of their scopes (scope, chunk_id, doc_id, ordinal), each with `set`, its concepts as JSON (if a pattern is given), and `hits`.

    hits: question_id, the dense and the sparse score where it can be among the k best of its question (else null), and
    the seed, the share of the question's distinct terms that the chunk holds. Questions that have neither are left out.
    """
    spark = chunks.sparkSession
    table = asked.select("question_id", *SCOPE, "avgdl", "words").toArrow()
    given = spark.sparkContext.broadcast(table)
    held = chunks.join(F.broadcast(asked.select(*SCOPE).distinct()), SCOPE, "left_semi")
    sets = F.to_json(F.sort_array(concepts("text", pattern))) if pattern is not None else F.lit("[]")
    held = held.select(*SCOPE, *PLACE, sets.alias("set"), "text")
    types, size = {f.name: f for f in held.schema.fields}, block
    hit = StructType([asked.schema["question_id"], StructField("dense", DoubleType()), StructField("sparse", DoubleType()), StructField("seed", DoubleType())])
    schema = StructType([*(types[c] for c in [*SCOPE, *PLACE]), StructField("set", StringType()), StructField("hits", ArrayType(hit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = given.value
        of_scope: dict[tuple, list[int]] = {}
        for r, scope in enumerate(zip(*(asked[c].to_pylist() for c in SCOPE))):
            of_scope.setdefault(scope, []).append(r)
        blocks: dict[tuple, list[Block]] = {}
        ids = asked["question_id"].combine_chunks()
        for b in batches:
            order = pc.sort_indices(b.select([*SCOPE, "doc_id", "ordinal"]), sort_keys=[(c, "ascending") for c in [*SCOPE, "doc_id", "ordinal"]], null_placement="at_start")
            b = b.take(order)
            length, words, row, word, tf = counted(b.column("text"))
            hashes = hashed(words.to_pylist(), dim, mode)
            scopes = [b.column(c).dictionary_encode(null_encoding="encode") for c in SCOPE]
            code = scopes[0].indices.to_numpy().astype(np.int64) * len(scopes[1].dictionary) + scopes[1].indices.to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, dtype=int)
            found: list[tuple] = []
            for low, high in zip(first, np.append(first[1:], len(code))):
                scope = tuple(b.column(c)[int(low)].as_py() for c in SCOPE)
                if scope not in blocks:
                    rows = of_scope.get(scope, [])
                    blocks[scope] = [Block(asked, rows[i : i + size], dim, mode) for i in range(0, len(rows), size)]
                for block in blocks[scope]:
                    step = block.rows(dim, cells)
                    for at in range(low, high, step):
                        n = min(high, at + step) - at
                        a, z = np.searchsorted(row, [at, at + n])
                        dense, sparse, seed = block.scores(n, length[at : at + n], row[a:z] - at, word[a:z], tf[a:z], words, hashes, dim)
                        for q, number in enumerate(block.ids):
                            top = [np.isin(np.arange(n), best(lane[:, q], k), assume_unique=True) for lane in (dense, sparse)]
                            keep = np.flatnonzero(top[0] | top[1] | (seed[:, q] > 0))
                            found.append((keep + at, np.full(len(keep), number), *(x[keep, q] for x in (dense, sparse)), seed[keep, q], *(t[keep] for t in top)))
            if not found:
                continue
            at, number, dense, sparse, seed, *top = (np.concatenate(x) for x in zip(*found))
            by_row = np.argsort(at, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(at, minlength=b.num_rows)))
            scores = [pa.array(x[by_row], mask=~t[by_row]) for x, t in zip((dense, sparse), top)]
            each = pa.StructArray.from_arrays([ids.take(pa.array(number[by_row])), *scores, pa.array(seed[by_row])], names=hit.fieldNames())
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            yield pa.RecordBatch.from_arrays([*b.select([*SCOPE, *PLACE, "set"]).columns, hits], names=schema.fieldNames())

    return held.mapInArrow(run, schema)


def lane_hits(rows: DataFrame, lane: str) -> DataFrame:
    """Of scanned rows, the hits of a lane ("dense" or "sparse") that can be among the best: question_id, scope, chunk_id, doc_id, ordinal, score."""
    return rows.select(*SCOPE, *PLACE, F.inline("hits")).where(F.col(lane).isNotNull()).select("question_id", *SCOPE, *PLACE, F.col(lane).alias("score"))


def seeds_of(rows: DataFrame) -> DataFrame:
    """Of scanned rows, the seeds as seed_scores() has them."""
    return rows.select(*SCOPE, "chunk_id", F.inline("hits")).where("seed > 0").select("question_id", *SCOPE, "chunk_id", "seed")
