"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Spark ML fits the machine on a bounded sample of labelled rows. Scoring uses the sum-of-squares identity: with inputs x,
weights w and factors v, the pairs add up to half of sum over f of (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2, so a text
costs time linear in its distinct inputs. Words are hashed; statistics are cut into steps so that the machine can pair
one step with another; the only metadata is the table's n_chars.

Defined results: a null or empty text has the inputs of an empty text; null n_chars counts as the text's own length; a
null doc_id counts as not held out; repeated rows are scored each; other columns are ignored; without labelled rows of
both classes every score is the share of label 1 (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from attesta.llm._common import carried, held_out, labelled_sample, materialize, prepare

HASHED, STEPS = 1 << 16, 8
#: Training rows that must hold an input for it to count (of few rows, a fiftieth).
MIN_ROWS = 20
#: The upper ends of the steps of each statistic.
CUTS = {
    "log_chars": [2, 3, 4, 5, 6, 7, 9],
    "meta_chars": [2, 3, 4, 5, 6, 7, 9],
    "distinct": [0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.85],
    "repeats": [0.001, 0.01, 0.03, 0.1, 0.3, 0.6, 0.85],
    "lines_again": [0.001, 0.05, 0.15, 0.3, 0.5, 0.7, 0.9],
    "caps": [0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7],
    "symbols": [0.001, 0.005, 0.01, 0.03, 0.06, 0.1, 0.2],
    "bars": [0.0005, 0.002, 0.005, 0.01, 0.03, 0.06, 0.1],
    "digits": [0.001, 0.005, 0.01, 0.03, 0.06, 0.1, 0.3],
    "word_chars": [2, 3, 4, 5, 6, 8, 12],
    "top_word": [0.02, 0.04, 0.07, 0.12, 0.2, 0.4, 0.7],
    "stops": [0.001, 0.005, 0.01, 0.02, 0.04, 0.06, 0.1],
    "line_words": [2, 5, 10, 20, 40, 80, 160],
}
SIZE = HASHED + len(CUTS) * STEPS
SYMBOLS = [ord(c) for c in "#$%&*+<=>@\\^_`{}~"]


def inputs_of(text: str | None, n_chars: int | None, cache: dict[str, int]) -> tuple[list[int], list[float]]:
    """Indices and values of the machine's inputs that are not zero."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    counted = Counter(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    bytes_ = np.bincount(raw, minlength=256)
    size, lines = max(1, len(text)), [x for x in text.split("\n") if x.strip()]
    letters = max(1, int(bytes_[65:91].sum() + bytes_[97:123].sum()))
    stats = {
        "log_chars": np.log1p(len(text)), "meta_chars": np.log1p(max(0, len(text) if n_chars is None else n_chars)), "distinct": len(counted) / n,
        "repeats": sum(a == b for a, b in zip(words, words[1:])) / n, "lines_again": 1 - len(set(lines)) / max(1, len(lines)),
        "caps": bytes_[65:91].sum() / letters, "symbols": bytes_[SYMBOLS].sum() / size, "bars": bytes_[124] / size, "digits": bytes_[48:58].sum() / size,
        "word_chars": sum(map(len, words)) / n, "top_word": max(counted.values(), default=0) / n, "stops": (bytes_[46] + bytes_[33] + bytes_[63]) / size,
        "line_words": n / max(1, len(lines)),
    }
    at = [HASHED + k * STEPS + int(np.searchsorted(CUTS[name], stats[name], side="right")) for k, name in enumerate(CUTS)]
    values = [1.0] * len(at)
    used, weight = np.zeros(0, dtype=np.int64), np.zeros(0)
    if counted:
        if len(cache) > 200_000:
            cache.clear()
        slots = []
        for w in counted:
            if (h := cache.get(w)) is None:
                h = crc32(w.lower().encode("utf-8", "replace")) % HASHED
                if len(w) <= 40:
                    cache[w] = h
            slots.append(h)
        used, place = np.unique(slots, return_inverse=True)
        weight = np.bincount(place, np.log1p(np.fromiter(counted.values(), dtype=float, count=len(counted))))
        weight /= np.sqrt((weight**2).sum())
    return [*used.tolist(), *at], [*weight.tolist(), *values]


def fm_score(at: list[int], values: list[float], intercept: float, linear: np.ndarray, factors: np.ndarray) -> float:
    """The machine's probability of label 1, by the sum-of-squares identity."""
    x, v = np.asarray(values), factors[at]
    vx = v * x[:, None]
    z = intercept + float(linear[at] @ x) + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, factor_size: int = 4, rounds: int = 80, threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """docs (doc_id, text, n_chars if there, ...) scored by a model of labels (doc_id, quality): doc_id, held_out, score, predicted.

    max_rows bounds the labelled rows used in training, one for each id. With carry, text and `rest` (all other columns) come along.
    """
    prepare(docs.sparkSession)
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    base = docs.select("doc_id", "text", chars.alias("n_chars"), *([carried(docs)] if carry else []))
    also = ["text", "rest"] if carry else []
    sample = labelled_sample(base.select("doc_id", "text", "n_chars"), labels, "quality", max_rows)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            rows = [inputs_of(t, c, cache) for t, c in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["label", "at", "vals"])

    known = sample.select("label", "text", "n_chars").mapInArrow(inputs, "label int, at array<int>, vals array<double>")
    known = materialize(known, "quality_inputs").coalesce(2)
    classes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(classes) < 2:
        score = F.lit(float(classes.get(1, 0) / max(1, sum(classes.values()))))
        return base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *also)
    # Inputs that few training rows hold would only be learned by heart, so they do not count; at most SIZE numbers.
    least = min(MIN_ROWS, max(1, sum(classes.values()) // 50))
    common = sorted(r["slot"] for r in known.select(F.explode("at").alias("slot")).groupBy("slot").count().where(F.col("count") >= least).select("slot").collect())
    # Numbered anew, so that each round sends and adds up numbers of these inputs only, not of all SIZE.
    number = {slot: i for i, slot in enumerate(common)}

    @F.udf(VectorUDT())
    def vector(at, values):
        return Vectors.sparse(len(number), sorted((number[a], v) for a, v in zip(at, values) if a in number))

    ready = materialize(known.select(F.col("label").cast("double").alias("label"), vector("at", "vals").alias("features")), "quality_vectors").coalesce(2)
    model = FMClassifier(labelCol="label", featuresCol="features", factorSize=factor_size, maxIter=rounds, stepSize=0.1, initStd=0.01, regParam=1e-3, seed=7, solver="adamW").fit(ready)
    intercept, linear, factors = float(model.intercept), np.zeros(SIZE), np.zeros((SIZE, factor_size))
    linear[common], factors[common] = model.linear.toArray(), model.factors.toArray()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            got = [fm_score(*inputs_of(t, c, cache), intercept, linear, factors) for t, c in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(got, pa.float64())], names=[*keep, "score"])

    keep = ["doc_id", *also]
    scored = base.mapInArrow(score, StructType([*(base.schema[c] for c in keep), StructField("score", DoubleType())]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *also)
