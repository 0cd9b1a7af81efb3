"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text are densities of a seed lexicon and of terms learned from labelled rows, how near such terms
stand to second-person words, capitals, punctuation and obfuscation rates. Spark ML fits the trees and the isotonic
curve on a bounded sample of labelled rows (`max_rows`); scoring runs on executors, a row at a time in Arrow batches.

Defined results: a null or empty text has zero features and a score like any other text; a null doc_id counts as not
held out; repeated rows are scored each; extra columns are ignored; without labelled rows of both classes every score
is the share of label 1 (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from attesta.llm._common import carried, held_out, labelled_sample, materialize, prepare

#: Common English insults.
SEED_LEXICON = """
asshole bastard bitch clown coward creep crap cretin damn dimwit disgusting dumb fool freak garbage idiot imbecile
jerk kill liar loser lunatic moron nasty nazi pathetic pig psycho racist retard scum shit slut stupid trash ugly
vermin whore worthless
""".split()
#: Second-person words of the languages met.
SECOND_PERSON = "you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes vosotros tus".split()
#: Signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MASKED = re.compile(r"(?<!\S)(?=\S*[A-Za-z])(?=\S*[0-9@$!*])[A-Za-z0-9@$!*]{3,}(?!\S)")
PREFIX, NEAR = 5, 6
#: Tenths of the sample that the lexicon is learned on (two draw the curve, the rest grow the trees), and the trees' own share of a score.
LEXICON_PARTS, TIE = 5, 1e-6
FEATURES = ["seed", "terms", "prefixes", "hits", "any", "near_you", "you", "caps", "exclaim", "punct", "masked", "masked_hits", "digits", "length"]


def terms_of(text: str | None) -> list[str]:
    """The distinct words of a text and, marked by a star, their beginnings of PREFIX letters."""
    words = set(WORD.findall((text or "").lower()))
    return sorted(words | {w[:PREFIX] + "*" for w in words if len(w) >= PREFIX})


def features_of(text: str | None, words_lex: frozenset, prefix_lex: frozenset, seeds=frozenset(SEED_LEXICON), you=frozenset(SECOND_PERSON)) -> list[float]:
    text = text or ""
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    seed_at = [i for i, w in enumerate(words) if w in seeds]
    term_at = [i for i, w in enumerate(words) if w in words_lex]
    pre_at = [i for i, w in enumerate(words) if w[:PREFIX] in prefix_lex] if prefix_lex else []
    you_at = [i for i, w in enumerate(words) if w in you]
    hits = sorted({*seed_at, *term_at, *pre_at})
    near = 0
    if hits and you_at:
        at, j = np.asarray(you_at), np.searchsorted(you_at, hits)
        gap = np.minimum(np.abs(at[np.minimum(j, len(at) - 1)] - hits), np.abs(at[np.maximum(j - 1, 0)] - hits))
        near = int((gap <= NEAR).sum())
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = max(1, len(text))
    upper, letters = int(counts[65:91].sum()), max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    digits = int(counts[48:58].sum())
    masked = MASKED.findall(text) if digits or counts[33] or counts[36] or counts[42] or counts[64] else []
    opened = [m.lower().translate(LEET).replace("*", "") for m in masked]
    return [
        len(seed_at) / n, len(term_at) / n, len(pre_at) / n, float(np.log1p(len(hits))), float(bool(hits)), near / n, len(you_at) / n,
        upper / letters, int(counts[33]) / size, int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / size,
        len(masked) / n, sum(w in seeds or w in words_lex for w in opened) / n, digits / size, float(np.log1p(len(text))),
    ]


def with_features(docs: DataFrame, keep: list[str], terms: list[str]) -> DataFrame:
    """keep and an array column `raw` of the features; terms: the learned lexicon."""
    words = frozenset(t for t in terms if not t.endswith("*"))
    prefixes = frozenset(t[:-1] for t in terms if t.endswith("*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = pa.array([features_of(t, words, prefixes) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), raw], names=[*keep, "raw"])

    given = docs.select(*dict.fromkeys([*keep, "text"]))
    return given.mapInArrow(run, StructType([*(given.schema[c] for c in keep), StructField("raw", ArrayType(DoubleType()))]))


def learn_terms(sample: DataFrame, max_terms: int = 400, min_rows: int = 5, min_log_odds: float = 2.0) -> list[str]:
    """Words and beginnings of words that mark label 1 in sample (text, label): the strongest max_terms by evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([terms_of(t) for t in b.column("text").to_pylist()], pa.list_(pa.string())), b.column("label")], names=["terms", "label"])

    totals = sample.agg(F.sum("label").alias("bad"), F.count("*").alias("n")).first()
    bad, good = float(totals["bad"] or 0), float((totals["n"] or 0) - (totals["bad"] or 0))
    if not bad or not good:
        return []
    by_term = sample.select("text", "label").mapInArrow(run, "terms array<string>, label int").select(F.explode("terms").alias("term"), "label")
    counted = by_term.groupBy("term").agg(F.sum("label").alias("b"), F.count("*").alias("n")).where(F.col("b") >= min_rows)
    odds = F.log((F.col("b") + 0.1) / bad) - F.log((F.col("n") - F.col("b") + 0.1) / good)
    best = counted.withColumn("odds", odds).where(F.col("odds") >= min_log_odds).withColumn("worth", F.col("odds") * F.sqrt("b"))
    return [r["term"] for r in best.orderBy(F.desc("worth"), "term").limit(max_terms).collect()]


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, trees: int = 20, depth: int = 3, carry: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) scored by a model of labels (doc_id, toxic): doc_id, held_out, score, predicted.

    max_rows bounds the labelled rows used in training, one for each id: half of them teach the lexicon, a fifth draws the
    calibration curve, the rest grow the trees.
    With carry, text and `rest` (all other columns) come along.
    """
    spark = prepare(docs.sparkSession)
    sample = materialize(labelled_sample(docs.select("doc_id", "text"), labels, "toxic", max_rows), "toxic_sample")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    base = docs.select("doc_id", "text", *([carried(docs)] if carry else []))
    also = ["text", "rest"] if carry else []
    if len(classes) < 2:
        score = F.lit(classes.get(1, 0) / max(1, sum(classes.values())))
        return base.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.cast("double").alias("score"), (score >= 0.5).cast("int").alias("predicted"), *also)
    # The lexicon is learned on one part, the trees on another and the curve on a third, else the trees would trust terms
    # that only their own rows hold. All of them, and the scores, see the same lexicon.
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10))
    terms = learn_terms(sample.where(part < LEXICON_PARTS))
    known = materialize(with_features(sample.withColumn("part", part), ["label", "part"], terms).withColumn("features", array_to_vector("raw")).drop("raw"), "toxic_features")
    known = known.coalesce(2)
    try_parts = [known.where((F.col("part") >= LEXICON_PARTS) & (F.col("part") < 8)), known.where("part >= 8")]
    if any(p.select("label").distinct().count() < 2 for p in try_parts):
        try_parts = [known, known]
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32).fit(try_parts[0])
    one = lambda df: df.withColumn("p", vector_to_array("probability")[1])
    curve = IsotonicRegression(labelCol="label", featuresCol="p", predictionCol="calibrated").fit(one(model.transform(try_parts[1])).select("p", F.col("label").cast("double").alias("label")))
    rows = with_features(base.withColumn("held_out", held_out(F.col("doc_id"))), ["doc_id", "held_out", *also], terms).withColumn("features", array_to_vector("raw"))
    scored = curve.transform(one(model.transform(rows)).select("doc_id", "held_out", "p", *also))
    # Isotonic steps tie many rows; a millionth of the trees' own probability keeps their order and moves no score that can be seen.
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - TIE) * F.col("calibrated") + TIE * F.col("p")))
    return scored.select("doc_id", "held_out", score.alias("score"), *also).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
