"""License scans by diagonal voting.

All rolling word k-gram hashes of all texts are joined by Spark with the positions of the same hashes in license
templates (a fixed, small table, so its side is broadcast). Each hit votes for its diagonal, text position less template
position; votes are added up by text, template and diagonal, and diagonals that lie close are merged (words put in or left
out shift them). A merged span is verified on the text's words there: a k-gram that was hit says which template words
stand at a place of the text, so the longest chain of hits that runs on in both is what the span holds of its template in
order; it must be a large enough share, and not drawn out. Phrases of up to three words, and so the base phrases, count
where all their k-grams stand on one diagonal, that is, where their words stand consecutively. k is two, as the shortest
fixed phrases have two words.

Defined results: a null text is empty; a text without words or hits has zero counts, null first_word and last_word, empty
labels and score 0; repeated rows are scanned each; a null doc_id is kept; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm._common import materialize, prepare

K, FACTOR = 2, np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own templates and their labels.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TEMPLATES = [*BASE.items(), *MORE.items()]
END = -1  # the hash of a text's last row, which matches template END and so gives each text a row of the result


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 11)


def rolled(hashes: np.ndarray) -> np.ndarray:
    """Rolling hashes of K words; END is kept free."""
    if len(hashes) < K:
        return np.zeros(0, dtype=np.int64)
    out = np.zeros(len(hashes) - K + 1, dtype=np.uint64)
    for k in range(K):
        out = out * FACTOR + hashes[k : len(hashes) - K + 1 + k]
    got = (out ^ (out >> np.uint64(29))).view(np.int64).copy()
    got[got == END] = 0
    return got


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, spot): a few hundred rows, whatever the corpus."""
    rows = [(END, -1, 0)]
    for n, (phrase, _) in enumerate(TEMPLATES):
        grams = rolled(np.array([word_hash(w) for w in phrase.split()], dtype=np.uint64))
        rows += [(int(g), n, i) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, spot int")


def grams_of(docs: DataFrame) -> DataFrame:
    """Per text: doc_id, row_key, n_words and the array of its rolling hashes, END last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            keys, n, offsets, parts = [], [], [0], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                t = t or ""
                lowered = t.lower() if t.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), t)
                words = WORD.findall(lowered)
                if len(known) > 200_000:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = word_hash(w)
                hashes = rolled(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)))
                parts += [hashes, np.array([END])]
                offsets.append(offsets[-1] + len(hashes) + 1)
                n.append(len(words))
                keys.append(xxhash.xxh3_128_hexdigest(f"{i}\0{t}".encode("utf-8", "replace")))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.string()), pa.array(n, pa.int64()), lists], names=["doc_id", "row_key", "n_words", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, row_key string, n_words long, grams array<long>")


def in_order(hits: Column, grams: Column) -> Column:
    """The most template k-grams in a chain of hits (pos, back = -spot; sorted) that runs on in the text and the template.

    longest[s]: the longest chain that ends at spot s. Hits of one place come with falling spots, so none follows another.
    """
    longest = F.array_repeat(F.lit(0), grams.cast("int"))

    def step(acc: Column, h: Column) -> Column:
        here = F.coalesce(F.array_max(F.slice(acc, F.lit(1), -h["back"])), F.lit(0)) + 1
        return F.transform(acc, lambda x, s: F.when(s == -h["back"], F.greatest(x, here)).otherwise(x))

    return F.array_max(F.aggregate(hits, longest, step))


def scan_licenses(docs: DataFrame, shift: int = 2, share: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Diagonals at most `shift` apart are merged; a span needs `share` of its template's k-grams.
    """
    spark = prepare(docs.sparkSession)
    each = grams_of(docs).select("doc_id", "row_key", "n_words", F.posexplode("grams").alias("pos", "gram"))
    hits = each.join(F.broadcast(template_grams(spark)), "gram").select("doc_id", "row_key", "n_words", "pos", "template", "spot")
    hits = materialize(hits, "license_hits")
    texts = hits.where(F.col("template") == END).select("doc_id", "row_key", "n_words")
    sizes = F.array(*(F.lit(len(p.split()) - K + 1) for p, _ in TEMPLATES))
    names = F.array(*(F.lit(label) for _, label in TEMPLATES))
    grams = F.get(sizes, F.col("template"))
    votes = hits.where(F.col("template") >= 0).select("row_key", "template", (F.col("pos") - F.col("spot")).alias("diagonal"), "pos", "spot").distinct()
    lines = votes.groupBy("row_key", "template", "diagonal").agg(F.count("*").alias("votes"), F.collect_list(F.struct("pos", (-F.col("spot")).alias("back"))).alias("hits"))
    ordered = Window.partitionBy("row_key", "template").orderBy("diagonal")
    island = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(ordered) <= shift, 0).otherwise(1)).over(ordered)
    whole, base = F.col("votes") == grams, F.col("template") < len(BASE)
    merged = lines.withColumn("island", island).groupBy("row_key", "template", "island").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        (F.max("diagonal") - F.min("diagonal")).alias("drift"),
        F.max(whole).alias("consecutive"),
        F.sum(F.when(base & whole, 1).otherwise(0)).alias("whole"),
        F.min(F.when(base & whole, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base & whole, F.col("diagonal"))).alias("last_word"),
    )
    # Phrases of up to three words must be consecutive; longer ones are verified by their longest chain in order.
    part = F.when(F.col("consecutive"), 1.0).when(grams > 2, in_order(F.col("hits"), grams) / grams).otherwise(0.0)
    measured = merged.withColumn("part", part)
    fits = F.col("consecutive") | (F.col("part") >= share) & (F.col("drift") <= F.greatest(F.lit(shift), (grams / 2).cast("int")))
    spans = measured.withColumn("share", F.when(fits, F.col("part")))
    label = F.get(names, F.col("template"))
    by_text = spans.groupBy("row_key").agg(
        F.sum("whole").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("share").alias("score"),
        F.array_sort(F.collect_set(F.when(F.col("whole") > 0, label))).alias("base"), F.array_sort(F.collect_set(F.when(F.col("share").isNotNull(), label))).alias("every"),
    )
    out = texts.join(by_text, "row_key", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce(F.concat_ws(",", "base"), F.lit("")).alias("base_labels"), F.coalesce(F.concat_ws(",", "every"), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
