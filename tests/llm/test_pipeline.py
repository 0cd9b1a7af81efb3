"""The pipeline against a plain version of each stage on the smallest tables."""

import re
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import packing, quality, secrets, simhash, toxicity
from attesta.llm.queries import tokenizer_path
from test_llm_operators import base_spans, shingle_set, slow_alike, slow_components


def test_stages(spark):
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    seen = docs
    for (name, stage), n in zip(corpus_pipeline.STAGES, range(5)):
        before, seen = seen, stage(spark, seen, at).cache()
        old = before.toPandas().set_index("doc_id").sort_index()
        new = seen.toPandas()
        if n < 4:
            assert seen.columns == docs.columns
            new = new.set_index("doc_id").sort_index()
        if n == 0:
            s = toxicity.toxicity_scores(before, labels).toPandas()
            assert list(new.index) == sorted(s.doc_id[s.predicted == 0])
        if n == 1:
            s = quality.quality_scores(before, labels).toPandas()
            assert list(new.index) == sorted(s.doc_id[s.predicted == 1])
        if n == 2:
            roots = slow_components([shingle_set(t) for t in old.text], slow_alike)
            assert list(new.index) == [i for k, i in enumerate(old.index) if roots[k] == k]
        if n == 3:
            for i, text in old.text.items():
                spans = base_spans(text)
                if not re.search("(?i)" + secrets.IDENT.replace("(?i)", ""), text) and "://" not in text:
                    out, last = "", 0
                    for a, _, b in spans:
                        if a >= last:
                            out += text[last:a] + "[secret]"
                        last = max(last, b)
                    assert new.text[i] == out + text[last:]
        if n == 4:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
            ids = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in old.text.items()}
            assert all(crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for r in new.itertuples())
            assert new.length.sum() == sum(map(len, ids.values())) and new.groupby("sequence_id").length.sum().max() <= 2048


def test_rows_without_id_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = simhash.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]
    at = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, df.where(F.lit(False)), at).count() == 0


def test_rows_are_judged_by_themselves(spark):
    """Null and repeated ids: each row's own score decides, and only near copies go."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    for n, name, scores, good in ((0, "toxic", toxicity.toxicity_scores, 0), (1, "quality", quality.quality_scores, 1)):
        told = scores(docs, labels).select("doc_id", "predicted").cache()
        bad, fine = (told.where(F.col("predicted") == v).orderBy("doc_id").first().doc_id for v in (1 - good, good))
        # the same two texts without an id, and both under one id that is not in the table
        pair = docs.where(F.col("doc_id").isin(bad, fine))
        more = docs.unionByName(pair.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(pair.withColumn("doc_id", F.lit(10**12)))
        text = pair.where(F.col("doc_id") == fine).first().text
        left = corpus_pipeline.STAGES[n][1](spark, more, at)
        assert left.columns == docs.columns
        odd = [(r.doc_id, r.text) for r in left.where("doc_id IS NULL OR doc_id = 1000000000000").collect()]
        assert sorted(odd, key=str) == [(10**12, text), (None, text)]
        assert left.count() == told.where(F.col("predicted") == good).count() + 2


def test_near_copies_without_or_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(100)]
    text, near = " ".join(words), " ".join([*words[:-1], "end"])
    other, third = " ".join(f"x{i}" for i in range(50)), " ".join(f"y{i}" for i in range(50))
    rows = [(None, text), (5, near), (7, other), (7, third), (7, third), (None, third + " z"), (None, "one of its own"), (None, "one of its own"), (None, None), (None, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, near), (7, other), (7, third), (None, "one of its own"), (None, None)], key=str)
