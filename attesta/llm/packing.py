"""Packing: best-fit decreasing of token runs into windows, planned on the histogram of run lengths.

Each text is tokenized once. A text longer than a window is first cut into full windows; what remains is a run shorter
than a window. Best-fit decreasing treats equal runs alike, so it needs only how many runs of each length there are: at
most `window` counts, a proven bound, whatever the corpus. A segment tree indexed by remaining capacity finds the
tightest open window for a length; a group of windows with equal contents is one entry, and equal runs fill it together.
Executors then number the runs of each length (in salted parts, as one length may hold most runs) and look their places
up. The salt is drawn when a run is written, so that equal rows part too; how many parts there are follows from the most
frequent length, so that none of its parts is more than a task's share.

Defined results: a null or empty text is one id, the end id; repeated rows are packed each; a null doc_id is kept;
extra columns are ignored; an empty table gives an empty result. Ties are taken in order of doc_id, then of content.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm._common import materialize, prepare

#: White-space characters in a row from which on the tokenizers library takes over.
LONG_RUN = 50_000
#: Salts drawn, and the runs that a salted part of the numbering is meant to hold.
SALTS, PART_RUNS = 1 << 20, 100_000


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """The byte-level BPE of a tokenizers file, run by tiktoken: the same ids, several times as fast (tested to be equal).

    A run of hundreds of thousands of white-space characters is beyond its pattern matcher; such a text is left to the
    tokenizers library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(open(path, encoding="utf-8").read())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letter[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    long_run, library = re.compile(r"\s{%d}" % LONG_RUN), []

    def encode(text: str) -> list[int]:
        if len(text) <= LONG_RUN or not long_run.search(text):
            return bpe.encode(text, allowed_special="all")
        if not library:
            library.append(Tokenizer.from_file(path))
        return library[0].encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for b in batches:
            row, start, length, check, total = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = encode(text or "")
                ids.append(end_id)
                raw = np.array(ids, dtype="<u4").tobytes()
                for at in range(0, len(ids), window):
                    n = min(window, len(ids) - at)
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    check.append(crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(ids))
            ids_of = b.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(x, pa.int64()) for x in (start, length, check, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


class Capacities:
    """A segment tree over remaining capacities 0..window: which hold open windows, and the least that is at least x."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        at = self.leaves + capacity
        self.tree[at] = is_open
        while at > 1:
            at //= 2
            self.tree[at] = self.tree[2 * at] or self.tree[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = self.leaves + least
        if self.tree[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of counts (length -> runs): (length, first rank, first sequence, runs in each sequence, offset).

    Runs of a length with ranks from `first rank` on go, `runs in each` at a time, to sequences from `first sequence` on.
    """
    open_groups: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first sequence, sequences)
    tree, out, sequences = Capacities(window), [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            open_groups.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:  # no open window fits: as many new ones as these runs fill
                each = window // length
                capacity, first, n = window, sequences, -(-left // each)
                sequences += n
            else:
                first, n = open_groups[capacity].pop()
                if not open_groups[capacity]:
                    tree.set(capacity, False)
                each = capacity // length
            whole = min(n, left // each)
            if whole:
                out.append((length, rank, first, each, window - capacity))
                put(capacity - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:  # the last window of this group is filled in part
                out.append((length, rank, first + whole, each, window - capacity))
                put(capacity - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(capacity if whole < n else 0, first + whole, n - whole)
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = prepare(docs.sparkSession)
    drawn = (F.rand(11) * SALTS).cast("int").alias("drawn")
    cut = materialize(pieces(docs, tokenizer_path, window, end_id).select("*", drawn), "pieces")
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    most, runs = max(by_length.values(), default=1), max(1, sum(by_length.values()))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.col("drawn") % min(SALTS, max(-(-most // PART_RUNS), -(-most * tasks // runs))))
    sized = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "sizes")
    places = plan(by_length, window)
    used: dict[int, int] = {}
    segments = []
    for k, (length, rank, first, each, offset) in enumerate(places):
        end = places[k + 1][1] if k + 1 < len(places) and places[k + 1][0] == length else by_length[length]
        segments.append((length, rank, end, first, each, offset))
    key = np.array([s[0] * (1 << 40) + s[1] for s in segments], dtype=np.int64)
    order = np.argsort(key)
    key, first, each, offset, begin = key[order], *(np.array([s[i] for s in segments], dtype=np.int64)[order] for i in (3, 4, 5, 1))
    shared = spark.sparkContext.broadcast((key, first, each, offset, begin))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, eachs, offsets, begins = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
            nth = rank - begins[at]
            sequence, where = firsts[at] + nth // eachs[at], offsets[at] + nth % eachs[at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(where)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    before = sized.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "rank").mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
