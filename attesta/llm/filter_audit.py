"""Filter interaction audit: what each of five filters removes at each step of all 120 orders, in wide packed counters.

A document fails some of the filters; with the labels that is one of 128 states. For each state a big integer holds, in
fields of 64 bits, what each of the 600 steps (an order and a place in it) does with such a document: removes it,
would have removed it had it still been there, removes it although it is good, removes it and it is toxic. States are
counted within parts; a part's integer is the sum of its states' integers times their counts, and unpacking its fields
gives all 600 rows. A field holds counts up to 2^64, more than there are rows, so no field runs over into the next.

Texts are read once, for the first four filters and a 128-bit hash; copies are found by the hash. A hash or an id that
holds more rows than a task's share is joined by broadcast.

Defined results: a null text is empty and a null source the part ''; an empty text fails the first filter only (and the
last, if it is a copy); of equal texts those of the smallest doc_id pass the last filter, repeated rows alike; a null
doc_id has no smaller one and is smaller than none; of several labels of a doc_id any counts; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from hashlib import md5
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._common import looked_up, materialize, pieces, prepare

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
STEPS = len(LETTERS)
FIELDS = len(ORDERS) * STEPS
#: Bits of a field, and the groups of FIELDS fields one after another; behind them one field for all rows and one for each filter that alone fails.
WIDTH = 64
REMOVED, REDUNDANT, GOOD_LOST, TOXIC_LOST = range(4)
ALL = 4 * FIELDS
#: Words, and what ends one.
BLANK, MARKS = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[#$%&*|]")


def own_failures(data: bytes, points: int, min_words: int = 50, distinct: int = 65, capitals: int = 5) -> int:
    """Which of the first four filters a text (UTF-8) of so many code points fails, as bits."""
    words, different, upper = 0, set(), 0
    for piece in pieces(data, BLANK):
        found = piece.split()  # bytes are split at exactly these six characters
        words += len(found)
        different.update(found)
        letters = np.frombuffer(piece, dtype=np.uint8)
        upper += int(np.count_nonzero((letters >= 65) & (letters <= 90)))
    return (words < min_words) | (100 * len(different) < distinct * words) << 1 | (100 * upper > capitals * points) << 2 | bool(MARKS.search(data)) << 3


@cache
def packed(state: int) -> int:
    """The counters of one document: state is the mask of its failed filters, plus 32 if it is good and 64 if it is toxic."""
    mask, good, toxic = state & 31, state >> 5 & 1, state >> 6 & 1
    total = 1 << ALL * WIDTH
    if mask.bit_count() == 1:
        total += 1 << (ALL + 1 + mask.bit_length() - 1) * WIDTH
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            if mask >> LETTERS.index(letter) & 1:
                at = o * STEPS + s
                kinds = [REDUNDANT] if gone else [REMOVED, *[GOOD_LOST] * good, *[TOXIC_LOST] * toxic]
                for kind in kinds:
                    total += 1 << (kind * FIELDS + at) * WIDTH
                gone = True
    return total


def unpacked(part: str, total: int) -> pa.RecordBatch:
    """All steps of all orders of one part."""
    fields = np.frombuffer(total.to_bytes((ALL + 1 + STEPS) * WIDTH // 8, "little"), dtype="<u8").astype(np.int64)
    removed, redundant, good, toxic = (fields[k * FIELDS : (k + 1) * FIELDS] for k in range(4))
    rows, alone = fields[ALL], fields[ALL + 1 :]
    letter = np.array([LETTERS.index(x) for order in ORDERS for x in order])
    kept = rows - np.cumsum(removed.reshape(-1, STEPS), axis=1).reshape(-1)
    shapley = np.array([removed[letter == k].sum() for k in range(STEPS)], dtype=np.int64)[letter]
    columns = {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": alone[letter], "good_lost": good, "toxic_lost": toxic, "shapley": shapley}
    head = {"part": pa.array([part] * FIELDS, pa.string()), "filter_order": pa.array([o for o in ORDERS for _ in range(STEPS)]), "step": pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))}
    return pa.RecordBatch.from_pydict(head | {k: pa.array(v) for k, v in columns.items()})


def part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, state, n) sorted by part in, all steps of each part out; holds one part's integer."""
    part, total = None, 0
    for b in batches:
        for p, state, n in zip(*(b.column(c).to_pylist() for c in ("part", "state", "n"))):
            if p != part:
                if part is not None:
                    yield unpacked(part, total)
                part, total = p, 0
            total += n * packed(state)
    if part is not None:
        yield unpacked(part, total)


def with_masks(docs: DataFrame) -> DataFrame:
    """part, doc_id, text_key (128 bits) and the mask of the first four filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, masks = [], []
            for text in b.column("text").to_pylist():
                data = text.encode("utf-8")
                keys.append(md5(data, usedforsecurity=False).digest())
                masks.append(own_failures(data, len(text)))
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())], names=["part", "doc_id", "text_key", "mask"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.select(empty("source", "part"), "doc_id", empty("text", "text")).mapInArrow(run, f"part string, doc_id {kind}, text_key binary, mask int")


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...), labels (doc_id, quality, toxic): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = prepare(docs.sparkSession)
    rows = materialize(with_masks(docs), "masks")
    copies = rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    found = looked_up(rows, copies.select("text_key", "least"), "text_key", copies)
    whole = F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 16).otherwise(0)
    masked = materialize(found.select("part", "doc_id", whole.alias("mask")), "whole_masks")
    yes = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((yes("quality") * 32 + yes("toxic") * 64).alias("marks"))
    # Only documents that fail a filter can be lost.
    failed = looked_up(masked.where("mask > 0"), marks, "doc_id").select("part", (F.col("mask") + F.coalesce("marks", F.lit(0))).alias("state"))
    states = failed.unionByName(masked.where("mask = 0").select("part", F.col("mask").alias("state")))
    counted = states.groupBy("part", "state").agg(F.count("*").alias("n"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counted.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(part_sums, schema)
