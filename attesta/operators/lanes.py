"""Ranked lanes (dense, BM25, citation graph), their indexes, fusion and reranking.

The scope (tenant_id, matter_id) is in every join key; scores are rounded before they are ranked, so that the order in
which Spark adds them up decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from attesta.functions import fixed
from attesta.functions.text import canonical_tokens, concepts, tokenize
from attesta.functions.words import counted, hashed
from attesta.operators import graph as G
from attesta.operators.graph import Graph
from attesta.operators.guards import own_corpora, select_sources
from attesta.operators.scan import lane_hits, scanned, seeds_of
from attesta.sources.scratch import cut, few

SCOPE = ["tenant_id", "matter_id"]
DIGITS = 9


def top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best chunks of each question; Spark cuts to k before the shuffle as well (window group limit)."""
    w = Window.partitionBy("question_id").orderBy(F.desc(score), "doc_id", "ordinal")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_of_scope(chunks: DataFrame, n: int) -> DataFrame:
    """The first n chunks of each scope in corpus order, with their number; Spark cuts to n before the shuffle as well."""
    w = Window.partitionBy(*SCOPE).orderBy("doc_id", "ordinal")
    return chunks.select(*SCOPE, "chunk_id", "doc_id", "ordinal").withColumn("number", F.row_number().over(w)).where(F.col("number") <= n)


def top_with_zeros(hits: DataFrame, questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each question where only hits (question_id, scope, chunk_id, doc_id, ordinal, score) have a score other than 0.

    Chunks without a hit score 0 and rank in corpus order, above negative hits. A question with fewer than k positive
    hits needs at most k of them, and they are among the first k + (its hits) chunks of its scope; so what is added is never
    more than the hits and k rows for each question, and no question meets all chunks of its scope.
    """
    hits = cut(hits, "hits")
    tally = hits.groupBy("question_id").agg(F.sum((F.col("score") > 0).cast("int")).alias("good"), F.count("*").alias("n"))
    short = questions.select("question_id", *SCOPE).join(tally, "question_id", "left").where(F.coalesce("good", F.lit(0)) < k)
    short = short.select("question_id", *SCOPE, (F.lit(k) + F.coalesce("n", F.lit(0))).cast("int").alias("reach"))
    most = short.agg(F.max("reach").alias("m")).first()["m"]
    if most is None:
        return top(hits, k)
    first = short.select("question_id", *SCOPE, F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("number")).join(first_of_scope(chunks, most), [*SCOPE, "number"])
    zeros = first.join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(hits.unionByName(zeros.select(*hits.columns)), k)


# Dense lane


def cosine(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return dot / F.when(size == 0, 1.0).otherwise(size)


def dense_top_k(questions: DataFrame, chunks: DataFrame, k: int = fixed.LANE_K, rows: int = 50_000) -> DataFrame:
    """questions (question_id, tenant_id, matter_id, q_vector) against chunks (..., embedding) of their scope.

    The chunks of a scope are dealt to salts of about `rows`, and each salt keeps its k best, so that a large scope is
    many tasks and only k rows of each leave them.
    """
    held = chunks.where(F.col("embedding").isNotNull())
    salts = max(8, -(-held.count() // rows))
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
    asked = questions.select("question_id", *SCOPE, "q_vector", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    scored = asked.join(dealt, [*SCOPE, "salt"]).withColumn("score", F.round(cosine(F.col("q_vector"), F.col("embedding")), DIGITS)).drop("q_vector", "embedding")
    w = Window.partitionBy("question_id", "salt").orderBy(F.desc("score"), "doc_id", "ordinal")
    return top(scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n", "salt"), k)


@F.pandas_udf(StructType([StructField("idx", LongType()), StructField("sign", IntegerType())]))
def _blake(words: pd.Series, dim: pd.Series) -> pd.DataFrame:
    digests = [blake2b(w.encode(), digest_size=8).digest() for w in words]
    return pd.DataFrame({"idx": [int.from_bytes(h[:4], "big") % n for h, n in zip(digests, dim)], "sign": [1 if h[4] % 2 == 0 else -1 for h in digests]})


def hash_weights(texts: DataFrame, dim: int = 384, mode: str = "blake2b", undefined: bool = False) -> DataFrame:
    """texts (id, text) as sparse unit vectors: id, idx, weight. A text whose words cancel out has none: no rows, or with `undefined` one of NaN for each idx.

    blake2b runs over distinct words only; mode "md5" is another hash, for comparison with engines that lack blake2b.
    """
    # Dealt by id, all counts of a text are made where it is.
    words = texts.select("id", "text").repartition("id").select("id", F.explode(tokenize("text")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("times"))
    if mode == "md5":
        h = F.md5("word")
        hashed = words.withColumns({"idx": F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim, "sign": F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)})
    else:
        vocabulary = words.select("word").distinct().withColumn("h", _blake("word", F.lit(dim))).select("word", "h.idx", "h.sign")
        hashed = words.join(vocabulary, "word")
    summed = hashed.groupBy("id", "idx").agg(F.sum(F.col("times") * F.col("sign")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # at most dim rows of a text
    weight = F.when(norm > 0, F.col("w") / F.when(norm > 0, norm)).otherwise(float("nan") if undefined else 0.0)
    return summed.select("id", "idx", weight.alias("weight")).where("weight <> 0")


def words_in_rows(texts: DataFrame, dim: int | None = None, mode: str = "blake2b") -> DataFrame:
    """texts (..., text): the other columns with the words of each row (dl, term, tf), or with its hashed weights (idx, weight) if dim is given.

    The same as grouping exploded words by row, for rows that are texts of their own: each batch is counted where it is,
    so no word is moved and no task holds more than a batch of them. A row leaves Python once, with an array of its words; its other columns are repeated behind that.
    """
    keys = [c for c in texts.columns if c != "text"]
    made = [StructField("term", StringType()), StructField("tf", LongType())] if dim is None else [StructField("idx", LongType()), StructField("weight", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, words, row, word, tf = counted(b.column("text"))
            if not len(row):
                continue
            if dim is None:
                found = {"term": words.take(pa.array(word)), "tf": tf.astype(np.int64)}
            else:
                idx, sign = hashed(words.to_pylist(), dim, mode)
                places, at = np.unique(row * dim + idx[word], return_inverse=True)
                w = np.bincount(at, weights=tf * sign[word])
                places, w = places[w != 0], w[w != 0]
                row = places // dim
                found = {"idx": places % dim, "weight": w / np.sqrt(np.bincount(row, weights=w * w, minlength=b.num_rows))[row]}
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            each = pa.StructArray.from_arrays([pa.array(found[f.name]) for f in made], names=[f.name for f in made])
            held = [*b.select(keys).columns, pa.array(length), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)]
            whole = pa.RecordBatch.from_arrays(held, names=[*keys, "dl", "each"])
            for low in range(0, b.num_rows, 512):
                yield whole.slice(low, 512)

    each = texts.select(*keys, "text").mapInArrow(run, StructType([*(texts.schema[c] for c in keys), StructField("dl", LongType()), StructField("each", ArrayType(StructType(made)))]))
    return each.select(*keys, *(["dl"] if dim is None else []), F.inline("each"))


def word_sums(texts: DataFrame) -> DataFrame:
    """texts (..., text): the other columns (a few different rows) with term, df (texts that hold it) and tf, by parts: each batch is added up where it is, and its sums are still to be added."""
    keys = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, words, row, word, tf = counted(b.column("text"))
            if not len(row):
                continue
            group = np.zeros(b.num_rows, dtype=np.int64)
            for c in keys:
                codes = b.column(c).dictionary_encode(null_encoding="encode")
                group = np.unique(group * max(1, len(codes.dictionary)) + codes.indices.to_numpy(), return_inverse=True)[1]
            first = np.unique(group, return_index=True)[1]
            pairs, at, df = np.unique(group[row] * len(words) + word, return_inverse=True, return_counts=True)
            rows = b.select(keys).take(pa.array(first[pairs // len(words)]))
            held = [*rows.columns, words.take(pa.array(pairs % len(words))), pa.array(df.astype(np.int64)), pa.array(np.bincount(at, weights=tf).astype(np.int64))]
            yield from pa.Table.from_arrays(held, names=[*keys, "term", "df", "tf"]).to_batches(10_000)

    return texts.select(*keys, "text").mapInArrow(run, StructType([*(texts.schema[c] for c in keys), StructField("term", StringType()), StructField("df", LongType()), StructField("tf", LongType())]))


def dense_vectors(weights: DataFrame, dim: int) -> DataFrame:
    m = F.map_from_entries(F.collect_list(F.struct("idx", "weight")))
    return weights.groupBy("id").agg(m.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("long")), F.lit(0.0))).alias("embedding"))


def hash_dense_top_k(questions: DataFrame, chunks: DataFrame, k: int = fixed.LANE_K, dim: int = 384, mode: str = "blake2b", weights: DataFrame | None = None) -> DataFrame:
    """The dense lane over hashed words: a sparse product by an equi-join on (scope, idx); other chunks of the scope score 0. weights: those of the chunks, if an index has them."""
    q = hash_weights(questions.select(F.col("question_id").alias("id"), F.col("question").alias("text")), dim, mode).withColumnRenamed("id", "question_id").withColumnRenamed("weight", "q")
    asked = few(questions.select("question_id", *SCOPE).join(q, "question_id"), "asked")
    if weights is None:
        c = hash_weights(chunks.select(F.col("chunk_id").alias("id"), "text"), dim, mode).withColumnRenamed("id", "chunk_id")
        held = chunks.select("chunk_id", *SCOPE, "doc_id", "ordinal").join(c, "chunk_id")
    else:
        held = weights
    score = (F.round(F.sum(F.col("q") * F.col("weight")), DIGITS) + 0.0).alias("score")
    hits = asked.join(held, [*SCOPE, "idx"]).groupBy("question_id", *SCOPE, "chunk_id", "doc_id", "ordinal").agg(score)
    return top_with_zeros(hits, questions, chunks, k)


def with_embeddings(chunks: DataFrame, vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """chunks with the vectors (chunk_id, embedding) that a model elsewhere supplied, as unit vectors; null where there is none or its size is not dim."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)
    fits = F.size(v) == dim if dim else F.lit(True)
    return chunks.join(vectors.select("chunk_id", F.when(fits, unit).alias("embedding")), "chunk_id", "left")


def means(x: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """Centres of so many clusters of the rows."""
    centres = x[np.random.default_rng(7).permutation(len(x))[:words]]
    for _ in range(rounds):
        near = codes_of(x, centres[None])[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def codebooks(sample: np.ndarray, part: int = 2, words: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Product quantisation of a sample (rows of unit vectors): centres, and of what is left beyond the nearest one, for each `part` dimensions, the means of clusters, as (parts, words, part)."""
    centres = means(sample, min(words, len(sample)))
    left, books = sample - centres[codes_of(sample, centres[None])[:, 0]], []
    for at in range(0, sample.shape[1], part):
        found = means(left[:, at : at + part], words)
        books.append(np.pad(found, ((0, words - len(found)), (0, part - found.shape[1]))))
    return centres, np.stack(books)


def codes_of(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest word of each part of each row."""
    out, part = np.empty((len(x), len(books)), dtype=np.uint8), books.shape[2]
    for m, words in enumerate(books):
        mine = x[:, m * part : (m + 1) * part]
        words = words[:, : mine.shape[1]]
        out[:, m] = np.argmax(mine @ words.T - (words * words).sum(1) / 2, axis=1)
    return out


def unit_rows(vectors: list, dim: int) -> np.ndarray:
    """Vectors as rows of length 1 (or 0), filled up with zeros; a null component counts as 0."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = [0.0 if e is None else e for e in v] if None in v else v
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def dense_top_k_approx(questions: DataFrame, chunks: DataFrame, k: int, rerank: int = 5, max_sample: int = 20_000, rows: int = 50_000, block: int = 4096, exact: bool = False) -> DataFrame:
    """Approximate: all chunks of the scope are scored by their product codes, and the `rerank` * k best of each salt by their vectors.

    A code is the nearest of some centres and, of what is left, a byte for each two dimensions; a question scores it by
    adding up entries of a table, one for each byte. Centres and code books are means of at most max_sample chunks; every chunk is coded. Chunks are dealt to salts of about
    `rows` and the questions of a scope to blocks, so a task holds one of each. exact: a code misses a score by no more than
    the length of what it leaves out, so all chunks that may be among the k best by that bound are scored by their vectors, however many.
    """
    held = chunks.where(F.col("embedding").isNotNull()).withColumn("embedding", F.col("embedding").cast("array<double>"))
    asked = questions.select("question_id", *SCOPE, F.col("q_vector").cast("array<double>").alias("q_vector")).where("q_vector IS NOT NULL")
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.greatest(F.max(F.size("embedding")), F.lit(1)), F.lit(1)).alias("dim")).first()
    dim = max(size["dim"], asked.agg(F.coalesce(F.max(F.size("q_vector")), F.lit(1)).alias("d")).first()["d"])
    sample = unit_rows([r["embedding"] for r in held.orderBy(F.xxhash64("chunk_id")).limit(max_sample).select("embedding").collect()], dim)
    centres, books = codebooks(sample if len(sample) else np.zeros((1, dim)))
    salts = max(1, -(-size["n"] // rows))
    most = asked.groupBy(*SCOPE).count().agg(F.max("count").alias("m")).first()["m"] or 1
    blocks = -(-most // block)
    left = asked.select("*", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    place = ["chunk_id", "doc_id", "ordinal"]
    right = held.select(*SCOPE, *place, "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    best = rerank * k

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        n = len(c) if len(q) else 0
        x, y = unit_rows(q["q_vector"].to_pylist(), dim), unit_rows(c["embedding"].to_pylist() if n else [], dim)
        cell, part, found = codes_of(y, centres[None])[:, 0], books.shape[2], []
        codes = codes_of(y - centres[cell], books)
        coded = books[np.arange(len(books)), codes].reshape(len(y), len(books) * part)[:, :dim] if exact else y
        miss = np.linalg.norm(y - centres[cell] - coded, axis=1)
        padded = np.pad(x, ((0, 0), (0, len(books) * part - dim)))
        for i in range(len(x) if n else 0):
            table = np.einsum("mwp,mp->mw", books, padded[i].reshape(len(books), part))
            about = (centres @ x[i])[cell] + table[np.arange(len(books)), codes].sum(1)
            if n <= best:
                mine = np.arange(n)
            elif exact:  # scores that are equal when rounded count as ties
                mine = np.flatnonzero(about + miss >= np.partition(about - miss, n - k)[n - k] - 10.0 ** (1 - DIGITS))
            else:
                mine = np.argpartition(-about, best - 1)[:best]
            found.append((np.full(len(mine), i), mine, y[mine] @ x[i]))
        i, j, score = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, dtype=int),) * 2 + (np.zeros(0),)
        rows_of = lambda t, names, at: {name: t[name].take(pa.array(at)) for name in names}
        return pa.table({**rows_of(q, ["question_id", *SCOPE], i), **rows_of(c, place, j), "score": score})

    kinds = {f.name: f for f in [*asked.schema.fields, *held.schema.fields]}
    schema = StructType([*(kinds[c] for c in ["question_id", *SCOPE, *place]), StructField("score", DoubleType())])
    keys = [*SCOPE, "salt", "block"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
    return top(scored.withColumn("score", F.round("score", DIGITS)), k)


# Sparse lane


def build_postings(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings (scope, term, chunk_id, doc_id, ordinal, tf, dl), terms (scope, term, df, idf), scopes (scope, n, avgdl)."""
    # Dealt by chunk, a chunk's words are counted where they are: texts are shuffled, which are smaller than their words.
    tokens = chunks.select(*SCOPE, "chunk_id", "doc_id", "ordinal", "text").repartition("chunk_id").withColumn("tokens", tokenize("text"))
    words = tokens.select(*SCOPE, "chunk_id", "doc_id", "ordinal", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    postings = cut(words.groupBy(*SCOPE, "term", "chunk_id", "doc_id", "ordinal", "dl").agg(F.count("*").alias("tf")), "postings")
    length = postings.groupBy(*SCOPE).agg(F.sum("tf").alias("length"))
    scopes = chunks.groupBy(*SCOPE).agg(F.count("*").alias("n")).join(length, SCOPE, "left").select(*SCOPE, "n", (F.coalesce("length", F.lit(0)) / F.col("n")).alias("avgdl"))
    return postings, inverse_frequencies(postings.groupBy(*SCOPE, "term").agg(F.count("*").alias("df")), scopes), scopes


def inverse_frequencies(frequencies: DataFrame, scopes: DataFrame) -> DataFrame:
    """frequencies (scope, term, df) with idf; that of very common terms is a share of the scope's mean."""
    raw = frequencies.join(scopes, SCOPE).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = few(raw.groupBy(*SCOPE).agg(F.avg("raw").alias("mean")), "means")
    return raw.join(mean, SCOPE).select(*SCOPE, "term", "df", F.when(F.col("raw") < 0, fixed.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25_top_k(questions: DataFrame, chunks: DataFrame, k: int = fixed.LANE_K, index: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """BM25 over the scope of each question; chunks without a question's terms score 0 and fill the list in corpus order. index: build_postings() of the chunks, if there is one."""
    postings, terms, scopes = index or build_postings(chunks)
    asked = questions.select("question_id", *SCOPE, F.explode(tokenize("question")).alias("term")).groupBy("question_id", *SCOPE, "term").agg(F.count("*").alias("times"))
    held = postings.select(*SCOPE, "term", "chunk_id", "doc_id", "ordinal", "tf", "dl")
    hit = few(few(asked, "asked").join(terms, [*SCOPE, "term"]).join(scopes, SCOPE), "asked").join(held, [*SCOPE, "term"])
    norm = F.col("tf") + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col("dl") / F.col("avgdl"))
    score = F.round(F.sum(F.col("times") * F.col("idf") * F.col("tf") * (fixed.BM25_K1 + 1) / norm), DIGITS).alias("score")
    return top_with_zeros(hit.groupBy("question_id", *SCOPE, "chunk_id", "doc_id", "ordinal").agg(score), questions, chunks, k)


# Graph lane


def graph_edges(chunks: DataFrame, pattern: str = fixed.CONCEPT, max_degree: int | None = None, held: DataFrame | None = None) -> DataFrame:
    """Edges in both directions (scope, src, dst, weight): neighbours in a document, and pairs that share a concept. held: the concepts of the chunks, if an index has them."""
    w = Window.partitionBy(*SCOPE, "doc_id").orderBy("ordinal")
    following = chunks.select(*SCOPE, F.col("chunk_id").alias("a"), F.lead("chunk_id").over(w).alias("b"), "ordinal", F.lead("ordinal").over(w).alias("next"))
    near = following.where("next = ordinal + 1").select(*SCOPE, "a", "b", F.lit(fixed.ADJACENT_WEIGHT).alias("weight"))
    held = chunks.select(*SCOPE, "chunk_id", F.explode(concepts("text", pattern)).alias("concept")) if held is None else held.select(*SCOPE, "chunk_id", "concept")
    if max_degree is not None:
        common = held.groupBy(*SCOPE, "concept").count().where(F.col("count") > max_degree).select(*SCOPE, "concept")
        held = held.join(common, [*SCOPE, "concept"], "left_anti")
    a, b = held.withColumnRenamed("chunk_id", "a"), held.withColumnRenamed("chunk_id", "b")
    shared = a.join(b, [*SCOPE, "concept"]).where("a < b").select(*SCOPE, "a", "b").distinct().withColumn("weight", F.lit(fixed.CONCEPT_WEIGHT))
    ends = near.unionByName(shared).select(*SCOPE, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    edges = ends.groupBy(*SCOPE, "a", "b").agg(F.max("weight").alias("weight"))
    return edges.select(*SCOPE, F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(*SCOPE, F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def seed_scores(questions: DataFrame, chunks: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """question_id, scope, chunk_id, seed: the share of the question's distinct terms that the chunk holds, if any. postings: those of the chunks, if there are."""
    q = questions.select("question_id", *SCOPE, F.array_distinct(tokenize("question")).alias("t"))
    asked = few(q.select("question_id", *SCOPE, F.size("t").alias("n_q"), F.explode("t").alias("term")), "asked")
    held = chunks.select(*SCOPE, "chunk_id", F.explode(F.array_distinct(tokenize("text"))).alias("term")) if postings is None else postings.select(*SCOPE, "chunk_id", "term")
    return asked.join(held, [*SCOPE, "term"]).groupBy("question_id", *SCOPE, "chunk_id", "n_q").agg(F.count("*").alias("n")).select("question_id", *SCOPE, "chunk_id", (F.col("n") / F.col("n_q")).alias("seed"))


def rank_masses(seeds: DataFrame, chunks: DataFrame, edges: DataFrame | Graph, rounds: int = fixed.ROUNDS, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Personalised PageRank in its sparse form: (question_id, scope, chunk_id, mass) of nodes that a question's seeds reach, and (scope, chunk_id, floor) of linked nodes.

    edges: pairs of graph_edges(), or a Graph, which has none. A node's rank is the sum of both. The recursion is linear: what remains of the uniform start is the same for every
    question (the floor, one more walk), and seeds spread over edges only. The mass of unlinked nodes goes back to the
    seeds p; with the share r = damping * (p on unlinked nodes), a round's factor of p has the closed form below.
    """
    if isinstance(edges, Graph):
        linked = edges.nodes.where("out > 0").select(*SCOPE, F.col("chunk_id").alias("src"), "out")
    else:
        linked = edges.groupBy(*SCOPE, "src").agg(F.sum("weight").alias("out"))
    nodes = chunks.select(*SCOPE, "chunk_id").join(linked.select(*SCOPE, F.col("src").alias("chunk_id"), F.lit(1).alias("linked")), [*SCOPE, "chunk_id"], "left")
    size = nodes.groupBy(*SCOPE).agg(F.count("*").alias("n"), F.count("linked").alias("n_linked"))
    with_p = seeds.join(seeds.groupBy("question_id").agg(F.sum("seed").alias("total")), "question_id").withColumn("p", F.col("seed") / F.col("total")).join(nodes, [*SCOPE, "chunk_id"])
    back = with_p.groupBy("question_id", *SCOPE).agg((F.sum(F.when(F.col("linked").isNull(), F.col("p")).otherwise(0.0)) * fixed.DAMPING).alias("r")).join(size, SCOPE)
    start = (1 - fixed.DAMPING) + fixed.DAMPING * (1 - F.col("n_linked") / F.col("n"))
    given = cut(with_p.select("question_id", *SCOPE, "chunk_id", "p").join(back.select("question_id", *SCOPE, "r", start.alias("c0")), ["question_id", *SCOPE]), "seeds")
    if isinstance(edges, Graph):
        now = G.rank_masses(given, edges, rounds)
        return now.where("question_id IS NOT NULL"), now.where("question_id IS NULL").select(*SCOPE, "chunk_id", F.col("mass").alias("floor"))
    steps = cut(edges.join(linked, [*SCOPE, "src"]).select(*SCOPE, F.col("src").alias("chunk_id"), "dst", (F.col("weight") / F.col("out") * fixed.DAMPING).alias("share")), "steps")
    uniform = nodes.where("linked IS NOT NULL").join(size, SCOPE).select(F.lit(None).cast(seeds.schema["question_id"].dataType).alias("question_id"), *SCOPE, "chunk_id", (1 / F.col("n")).alias("mass"))
    now = uniform
    for t in range(rounds):
        factor = (1 - fixed.DAMPING) * (1 - F.pow("r", F.lit(t))) / (1 - F.col("r")) + F.col("c0") * F.pow("r", F.lit(t))
        added = given.select("question_id", *SCOPE, "chunk_id", (F.col("p") * factor).alias("mass"))
        moved = now.join(steps, [*SCOPE, "chunk_id"]).select("question_id", *SCOPE, F.col("dst").alias("chunk_id"), (F.col("mass") * F.col("share")).alias("mass"))
        now = moved.unionByName(added).groupBy("question_id", *SCOPE, "chunk_id").agg(F.sum("mass").alias("mass"))
        if t % every == every - 1 or t == rounds - 1:
            now = cut(now, "masses")
    return now.where("question_id IS NOT NULL"), now.where("question_id IS NULL").select(*SCOPE, "chunk_id", F.col("mass").alias("floor"))


def page_rank(seeds: DataFrame, chunks: DataFrame, edges: DataFrame | Graph, rounds: int = fixed.ROUNDS) -> DataFrame:
    """The rank of every node of a question's scope: question_id, chunk_id, rank_mass. Only this result has a row for each; the walk has not."""
    mass, floor = rank_masses(seeds, chunks, edges, rounds)
    every = seeds.select("question_id", *SCOPE).distinct().join(chunks.select(*SCOPE, "chunk_id").join(floor, [*SCOPE, "chunk_id"], "left"), SCOPE)
    return every.join(mass.select("question_id", "chunk_id", "mass"), ["question_id", "chunk_id"], "left").select("question_id", "chunk_id", (F.coalesce("mass", F.lit(0.0)) + F.coalesce("floor", F.lit(0.0))).alias("rank_mass"))


def graph_top_k(questions: DataFrame, chunks: DataFrame, edges: DataFrame | Graph, k: int = fixed.LANE_K, postings: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """A quarter of the rank mass, a tenth of the own seed, and the neighbours' seeds by edge weight; no seeds, no rows. seeds: seed_scores() of the questions, if they were made before.

    Nodes that a question does not reach have the floor alone, so only the k highest floors of the scope can be among its best.
    """
    seeds = cut(seed_scores(questions, chunks, postings) if seeds is None else seeds, "seed_scores")
    mass, floor = rank_masses(seeds, chunks, edges)
    own = seeds.select("question_id", *SCOPE, "chunk_id", (fixed.SEED_SHARE * F.col("seed")).alias("s"))
    if isinstance(edges, Graph):
        around = G.spread(seeds.select("question_id", *SCOPE, "chunk_id", F.col("seed").alias("v")), edges).withColumnRenamed("v", "s")
    else:
        around = seeds.join(edges.withColumnRenamed("src", "chunk_id"), [*SCOPE, "chunk_id"]).select("question_id", *SCOPE, F.col("dst").alias("chunk_id"), (F.col("seed") * F.col("weight")).alias("s"))
    reached = mass.select("question_id", *SCOPE, "chunk_id", (fixed.RANK_SHARE * F.col("mass")).alias("s")).unionByName(own).unionByName(around).groupBy("question_id", *SCOPE, "chunk_id").agg(F.sum("s").alias("s"))
    reached = cut(reached, "reached")  # scored, and taken off the others
    placed = chunks.select(*SCOPE, "chunk_id", "doc_id", "ordinal").join(floor, [*SCOPE, "chunk_id"], "left").withColumn("floor", fixed.RANK_SHARE * F.coalesce("floor", F.lit(0.0)))
    scored = reached.join(placed, [*SCOPE, "chunk_id"]).withColumn("score", F.round(F.col("s") + F.col("floor"), DIGITS)).drop("s", "floor")
    w = Window.partitionBy(*SCOPE).orderBy(F.desc("least"), "doc_id", "ordinal")
    highest = placed.withColumn("least", F.round("floor", DIGITS)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    asked = seeds.select("question_id", *SCOPE).distinct()
    others = asked.join(highest, SCOPE).join(reached.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti").withColumn("score", F.col("least"))
    return top(scored.unionByName(others.select(*scored.columns)), k).where("score > 0")


# All lanes at once


def search_lanes(questions: DataFrame, index, k: int = fixed.LANE_K, graph: bool = True, limit: int = 200_000) -> list[DataFrame]:
    """The dense, sparse and (with `graph`) graph lane of questions over a standing Index: the k best chunks of each.

    Questions with up to `limit` different words are sent to all tasks and score the chunks in one pass over their texts (scan.py); the
    graph lane of a scope is then one task, but for scopes too large for that. More questions search the index's
    tables of words by joins.
    """
    words = questions.select("question_id", *SCOPE, F.explode(tokenize("question")).alias("term")).groupBy("question_id", *SCOPE, "term").agg(F.count("*").alias("times"))
    words = cut(words, "asked")
    if words.count() + questions.count() > limit:
        chunks, held = index.chunks(), index.postings()
        lanes = [hash_dense_top_k(questions, chunks, k, index.dim, index.mode, index.weights()), bm25_top_k(questions, chunks, k, held)]
        return [*lanes, graph_top_k(questions, chunks, G.concept_graph(chunks, held=index.concepts()), k, held[0])] if graph else lanes
    terms, scopes = index.frequencies()
    known = cut(F.broadcast(words).join(terms, [*SCOPE, "term"]).select("question_id", "term", "idf"), "known")
    each = words.join(known, ["question_id", "term"], "left").groupBy("question_id").agg(F.collect_list(F.struct("term", "times", "idf")).alias("words"))
    asked = cut(questions.select("question_id", *SCOPE).join(scopes.select(*SCOPE, "avgdl"), SCOPE).join(each, "question_id", "left"), "questions")
    rows = cut(scanned(asked, index.chunks(), k, index.dim, index.mode, index.pattern if graph else None), "scanned")
    lanes = [top(lane_hits(rows, lane), k) for lane in ("dense", "sparse")]
    if not graph:
        return lanes
    best, large = G.scanned_top(rows, k, DIGITS)
    best = cut(top(best, k), "graph_lane")
    if large is not None:
        part = rows.join(F.broadcast(large), SCOPE, "left_semi")
        held = part.select(*SCOPE, "chunk_id", F.explode(F.from_json("set", "array<string>")).alias("concept"))
        best = best.unionByName(graph_top_k(questions, part, G.concept_graph(part, held=held), k, seeds=seeds_of(part)).select(*best.columns))
    return [*lanes, best]


# Fusion and reranking


def fuse(dense: DataFrame, sparse: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion in one shuffle: question_id, scope, chunk_id, doc_id, ordinal, score and each lane's own score and rank."""
    lanes = [("dense", 1.0, dense), ("sparse", 1.0, sparse), *([("graph", fixed.GRAPH_WEIGHT, graph)] if graph is not None else [])]
    keys = ["question_id", *SCOPE, "chunk_id", "doc_id", "ordinal"]
    tagged = [df.select(*keys, F.lit(i).alias("lane"), "rank", "score", (w / (fixed.RRF_CONSTANT + F.col("rank"))).alias("part")) for i, (_, w, df) in enumerate(lanes)]
    both = reduce(DataFrame.unionByName, tagged)
    own = [F.max(F.when(F.col("lane") == i, F.col("score"))).alias(f"{n}_score") for i, n in enumerate(("dense", "sparse", "graph"))]
    place = F.min(F.struct("lane", "rank")).alias("place")
    fused = both.groupBy(*keys).agg(F.sum("part").alias("rrf"), *own, place)
    bonus = F.greatest(F.lit(0.0), F.least(F.coalesce("graph_score", F.lit(0.0)), F.lit(1.0))) * fixed.GRAPH_BONUS
    return fused.withColumn("score", F.col("rrf") + bonus).drop("rrf").fillna(0.0, ["dense_score", "sparse_score", "graph_score"])


def candidates(fused: DataFrame, questions: DataFrame, chunks: DataFrame, n: int = fixed.RERANK_INPUT) -> DataFrame:
    """With the bonus for shared terms, the first n of each question; ties by lane order, then rank in the lane. Adds question and text."""
    own = ["top_k"] if "top_k" in questions.columns else []
    joined = few(fused.join(questions.select("question_id", "question", *own), "question_id"), "fused").join(chunks.select("chunk_id", *SCOPE, "filename", "text"), ["chunk_id", *SCOPE])
    overlap = F.size(F.array_intersect(F.array_distinct(tokenize("question")), F.array_distinct(tokenize("text"))))
    scored = joined.withColumn("score", F.round(F.col("score") + F.least(overlap, F.lit(fixed.OVERLAP_CAP)) * fixed.OVERLAP_BONUS, DIGITS))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "place")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once for each row, however often it is used: expressions inside a function of array elements are made anew for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def rerank_score(question: str = "question", text: str = "text", score: str = "score", definitions: bool = True) -> Column:
    """Coverage, density and a share of the fused score; with `definitions` also the boost of texts that define a term, for questions that ask for a definition."""
    tokens = F.struct(tokenize(question).alias("terms"), tokenize(text).alias("words"))
    own = lambda t: F.filter(t["terms"], lambda x: ~x.isin(fixed.RERANK_STOPWORDS))
    both = lambda t: F.struct(t["terms"].alias("terms"), t["words"].alias("words"), own(t).alias("content"))
    sets = lambda t: F.struct(*(t[c].alias(c) for c in ("terms", "words", "content")), canonical_tokens(t["content"]).alias("asked"), canonical_tokens(t["words"]).alias("held"))
    return once(tokens, lambda t: once(both(t), lambda u: once(sets(u), lambda v: _rerank_score(v, text, score, definitions))))


def _rerank_score(tokens: Column, text: str, score: str, definitions: bool) -> Column:
    """tokens: a struct of terms (of the question), words (of the text), content (terms that are no stop words), asked and held (the canonical tokens of content and words)."""
    terms, words, content, query_set = tokens["terms"], tokens["words"], tokens["content"], tokens["asked"]
    coverage = F.size(F.array_intersect(query_set, tokens["held"])) / F.size(query_set)
    density = F.size(F.filter(words, lambda w: F.array_contains(query_set, w))) / F.size(words)
    low = F.lower(F.col(text))

    def boost(acc: Column, t: Column) -> Column:
        long_form = F.regexp_like(low, F.concat(F.lit(fixed.LONG_FORM), t, F.lit(r"\)")))
        as_form = F.regexp_like(low, F.concat(F.lit(r"\b"), t, F.lit(fixed.AS_FORM)))
        return acc + F.when(long_form, fixed.LONG_FORM_BOOST).otherwise(0.0) + F.when(as_form, fixed.AS_FORM_BOOST).otherwise(0.0)

    asks = F.array_join(terms, " ").rlike(fixed.ASKS_DEFINITION)
    phrase = reduce(lambda a, b: a | b, (low.contains(p) for p in fixed.RERANK_PHRASES))
    boosted = F.least(F.lit(fixed.MAX_BOOST), F.aggregate(content, F.lit(0.0), boost) + F.when(phrase, fixed.PHRASE_BOOST).otherwise(0.0))
    boost_of = F.when(asks, boosted).otherwise(0.0) if definitions else F.lit(0.0)
    full = fixed.COVERAGE * coverage + fixed.DENSITY * density + boost_of + fixed.FUSED_SHARE * F.least(F.col(score), F.lit(1.0))
    return F.when(F.size(content) == 0, F.col(score)).when(F.size(words) == 0, 0.0).otherwise(full)


def slots(scored: DataFrame, limit: int) -> Column:
    """How many results a question gets: its own top_k where it has one, else `limit`."""
    return F.coalesce(F.col("top_k"), F.lit(limit)) if "top_k" in scored.columns else F.lit(limit)


def sparse_backfill(scored: DataFrame, limit: int = fixed.TOP_K) -> DataFrame:
    """scored (question_id, rerank_score, sparse_score, rank, perhaps top_k): the best by rerank score, but the last slots by the sparse lane; final rank in order of selection."""
    by = lambda *c: F.row_number().over(Window.partitionBy("question_id").orderBy(*c))
    ranked = scored.withColumn("r1", by(F.desc("rerank_score"), "rank")).withColumn("r2", by(F.desc("sparse_score"), "rank"))
    n = slots(scored, limit)
    primary = F.greatest(F.lit(0), n - F.least(F.floor(n / 2).cast("int"), F.lit(fixed.BACKFILL)))
    key = F.when(F.col("r1") <= primary, F.struct(F.lit(0).alias("a"), F.col("r1").alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("r2").alias("b")))
    return ranked.withColumn("rank", by(key)).where(F.col("rank") <= n).drop("r1", "r2")


def rerank(cands: DataFrame, limit: int = fixed.TOP_K, definitions: bool = True) -> DataFrame:
    """By lexical rerank score, with the last slots kept for the best of the sparse lane."""
    return sparse_backfill(cands.withColumn("rerank_score", F.round(rerank_score(definitions=definitions), DIGITS)), limit)


def rerank_none(cands: DataFrame, limit: int = fixed.TOP_K) -> DataFrame:
    return cands.where(F.col("rank") <= slots(cands, limit))


def rerank_supplied(cands: DataFrame, scores: DataFrame, limit: int = fixed.TOP_K) -> DataFrame:
    """scores (question_id, chunk_id, rerank_score) from a model that ran elsewhere."""
    w = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), "first")
    joined = cands.withColumnRenamed("rank", "first").join(scores, ["question_id", "chunk_id"])
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= slots(cands, limit))


def retrieve(questions: DataFrame, chunks: DataFrame | None, graph: bool = True, limit: int = fixed.TOP_K, pattern: str = fixed.CONCEPT, mode: str = "blake2b", placement: str = "prefilter", index=None, definitions: bool = True, sparse: DataFrame | None = None) -> DataFrame:
    """All lanes, fusion, candidate cut and reranking for a table of questions, each with its top_k if it has one.

    index: a standing Index instead of chunks; its tables are read, and its mode and pattern hold. Questions may select documents (doc_ids; an empty selection is none). Their lanes then search and count over the
    selected documents only; with placement "parity" the dense lane searches the whole scope and drops other documents
    after its cut. sparse: the BM25 lane of these questions (bm25_top_k()), if it was searched before.
    """
    if index is not None:
        chunks, pattern, mode = index.chunks(), index.pattern, index.mode
    selecting = "doc_ids" in questions.columns
    if index is not None and not selecting:
        lanes = search_lanes(questions, index, graph=graph)
        if sparse is not None:
            lanes[1] = sparse
        return rerank(candidates(fuse(*lanes), questions, chunks), limit, definitions)
    asked, corpus = own_corpora(questions, chunks) if selecting else (questions, chunks)
    scopes = questions.select("question_id", *SCOPE)
    back = lambda lane: lane.drop(*SCOPE).join(scopes, "question_id") if selecting else lane
    if selecting and placement == "parity":
        every = hash_dense_top_k(questions, chunks, mode=mode)
        kept = every.join(select_sources(questions, chunks).select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_semi")
        dense = kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))
    else:
        dense = back(hash_dense_top_k(asked, corpus, mode=mode))
    words = build_postings(corpus)
    lanes = [dense, back(bm25_top_k(asked, corpus, index=words)) if sparse is None else sparse]
    if graph:
        lanes.append(back(graph_top_k(asked, corpus, G.concept_graph(corpus, pattern), postings=words[0])))
    return rerank(candidates(fuse(*lanes), questions, chunks), limit, definitions)
