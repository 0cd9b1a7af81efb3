"""Models in tasks: made once in each, checked results."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import hooks as H


def test_one_set_up_for_each_task(spark):
    """Three tasks with several batches each: three models, whatever the number of batches."""
    made, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        made.add(1)

        def model(texts):
            seen.add(1)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        texts = spark.range(0, 300, 1, 3).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
        got = H.encode(texts, make, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 300 and all(r.embedding == [r.id, 1.0] for r in got)
    assert made.value == 3 and seen.value >= 30


def test_wrong_results_are_errors(spark):
    texts = spark.createDataFrame([("a",), (None,), ("b",)], "text string")
    assert {str(r.embedding) for r in H.encode(texts, lambda: lambda ts: [None if t is None else [1.0, 2.0] for t in ts], 2).collect()} == {"None", "[1.0, 2.0]"}
    with pytest.raises(Exception, match="another size than 3"):
        H.encode(texts, lambda: lambda ts: [[1.0, 2.0]] * len(ts), 3).collect()
    with pytest.raises(Exception, match="results for"):
        H.encode(texts, lambda: lambda ts: [], 3).collect()
    assert H.encode(texts.limit(0), lambda: lambda ts: [], 3).count() == 0


def test_scanner_reranker_and_extractor(spark):
    pairs = spark.createDataFrame([(1, "q", "long text"), (2, "question", "t")], "id long, question string, text string")
    assert {r.id: r.rerank_score for r in H.rerank_with(pairs, lambda: lambda ps: [float(len(t) - len(q)) for q, t in ps]).collect()} == {1: 8.0, 2: -7.0}
    assert {r.id: (r.valid, r.risk) for r in H.scan_with(pairs, lambda: lambda ts: [(len(t) > 1, 1 / len(t)) for t in ts]).collect()} == {1: (True, 1 / 9), 2: (False, 1.0)}
    files = spark.createDataFrame([(1, b"a|b"), (2, b" "), (3, None)], "doc_id long, content binary")
    pages = H.extract_pages(files, lambda: lambda cs: [[(i + 1, p) for i, p in enumerate(bytes(c).decode().split("|"))] if c else [] for c in cs])
    assert sorted(map(tuple, pages.collect())) == [(1, 1, "a"), (1, 2, "b")]
