"""Removal of long repeats by run-length indexes: each byte that a string of `length` bytes covers which also starts earlier.

Where equal strings meet. A string's anchor is the leftmost of its `gram`-byte substrings with the least hash, so equal
strings have equal anchors at equal places. Successive strings of a text with one anchor are a run, and a run is known by
the hash of its anchor and the hash of its whole content (128 bits together). Runs are shuffled and sorted by both, as
numbers only: the first of equal runs stands for all, the others are covered without a look at their text. Anchors
that one content alone has are done. Only for what is left (different contents around one anchor) texts are read again:
their contents are dealt to buckets by anchor.

In a bucket the contents form a collection that repeats itself. Its Burrows-Wheeler transform is kept as runs, with
the text positions at the runs' heads and the lengths of their matches (RunIndex). Matching statistics are streamed from
these samples alone: a position takes the statistics of the next sampled one, moved by their distance. Positions whose
match is at least `length` long are chained to what they match; all of a chain but its earliest are marked.

An anchor with more than `crowd` different contents would make too large a bucket (a passage that very many texts share
makes such ones at its ends, where each text goes on in its own way). Its runs are cut into blocks of BLOCK strings by
their distance from the anchor, which are shuffled and judged as runs are; the strings of blocks that are still of
several contents are dealt one by one, by their own 128-bit hash.

A text that more rows hold than a task's share is taken in once, before all this; its copies of larger doc_ids are covered
as a whole. There are fewer such texts than shuffle partitions, so they are told by a broadcast. Texts are named by 64 bits
beside their doc_id.

Defined results: a null text is empty; earlier means a smaller (doc_id, start), so rows that share a doc_id are one
document in which equal starts are not earlier; a null doc_id is larger than all others; repeated rows have equal
results; a text of fewer than `length` bytes loses nothing; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._common import looked_up, materialize, prepare

LENGTH, GRAM = 100, 32
#: Positions of a text that are worked on at a time.
STRETCH = 1 << 20
#: Bytes of a bucket's contents, and the different contents of one anchor beyond which its strings are dealt one by one.
BUCKET_BYTES, CROWD = 1 << 20, 4096
#: Strings of a block of a crowded run.
BLOCK = 8
#: Odd multipliers and a table that make hashes of bytes.
_RANDOM = np.random.default_rng(13)
_BYTE = _RANDOM.integers(0, 1 << 63, size=256, dtype=np.uint64)
_ODD = _RANDOM.integers(0, 1 << 62, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RUN = "h long, c long, d long, t long, start int, strings int"


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each substring of `gram` (a power of two) bytes, made by doubling and mixed at the end."""
    h, size, k = _BYTE[data], 1, 0
    while size < gram:
        h = h[:-size] * _ODD[k] + h[size:]
        size, k = size * 2, k + 1
    h ^= h >> np.uint64(31)
    h *= _ODD[-1]
    h ^= h >> np.uint64(29)
    return h


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of the leftmost one whose upper 32 bits are least."""
    # The place below the value: of equal values the left one is less.
    key, size = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        key = np.minimum(key[:-step], key[step:])
        size += step
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(data: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of a text in stretches: start and number of the strings of each run, and the hash of its anchor."""
    whole, width = np.frombuffer(data, dtype=np.uint8), length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), STRETCH):
        h = gram_hashes(whole[at : at + STRETCH + length - 1], gram)
        anchor = leftmost_least(h, width)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        yield first + at, np.diff(np.append(first, len(anchor))), h[anchor[first]]


def document_runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Distinct runs of a text (h, c, start, strings), and the runs (start, strings) that repeat one of them further on in it."""
    parts = list(runs_of(data, length, gram))
    start, strings, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 3
    digest = xxhash.xxh3_64_intdigest
    c = np.fromiter((digest(data[a : a + n + length - 1]) for a, n in zip(start.tolist(), strings.tolist())), dtype=np.uint64, count=len(start))
    h = h.astype(np.uint64)
    order = np.lexsort((start, c, h))
    again = np.zeros(len(start), dtype=bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
    first, more = ~again, np.flatnonzero(again)
    # Repeats that follow one another are one.
    heads = np.flatnonzero(np.concatenate([[True], start[more[1:]] != start[more[:-1]] + strings[more[:-1]]])) if len(more) else more
    total = np.add.reduceat(strings[more], heads) if len(more) else more
    return h[first], c[first], start[first], strings[first], start[more[heads]] if len(more) else more, total


def find_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts (d, t, text) to RUN rows; those without a content (c null) are repeats inside their text, under a hash of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, text in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("text").to_pylist()):
                h, c, start, strings, again, more = document_runs(text.encode("utf-8"), length, gram)
                n, m = len(start), len(again)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([h.view(np.int64), again ^ t]), pa.int64()), pa.array([*c.view(np.int64).tolist(), *[None] * m], pa.int64()), pa.array([d] * (n + m), pa.int64()), pa.array([t] * (n + m), pa.int64()),
                            pa.array(np.concatenate([start, again]), pa.int32()), pa.array(np.concatenate([strings, more]), pa.int32()),
                        ],
                        names=["h", "c", "d", "t", "start", "strings"],
                    )

    return texts.select("d", "t", "text").mapInArrow(run, RUN)


def run_rows(h: pa.Array, b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([h, *b.columns[1:]], names=b.schema.names)


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUN rows sorted by all columns in; out those that are covered (h null) and those whose anchor has several contents, the first of each.

    Holds one batch and the first run of the last anchor.
    """
    held = None  # the last anchor's first runs, while it has one content only
    last = None  # the last row's anchor and content, and the first of that content: (h, c, d, start)
    several = False  # whether the last anchor has several contents

    for b in batches:
        inside = b.column("c").is_null()
        if inside.true_count:
            again = b.filter(inside)
            yield run_rows(pa.nulls(again.num_rows, pa.int64()), again)
            b = b.filter(b.column("c").is_valid())
        if not b.num_rows:
            continue
        h, c, d, start = (b.column(x).to_numpy() for x in ("h", "c", "d", "start"))
        new_h, new_c = np.ones(len(h), dtype=bool), np.ones(len(h), dtype=bool)
        new_h[1:] = h[1:] != h[:-1]
        if last is not None:
            new_h[0] = h[0] != last[0]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        if last is not None:
            new_c[0] = new_h[0] or c[0] != last[1]
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
        first_d, first_start = d[head], start[head]
        if last is not None and not new_c[0]:
            first_d, first_start = np.where(head < 0, last[2], first_d), np.where(head < 0, last[3], first_start)
        covered = ~new_c & ((d > first_d) | (start > first_start))
        group = np.cumsum(new_h)  # 0: the anchor goes on from the last batch
        contents = np.bincount(group, new_c, minlength=group[-1] + 1)
        many = contents > 1
        if last is not None and not new_h[0]:
            many[0] = several or contents[0] > 0
            if many[0] and held is not None:
                yield held
                held = None
        else:
            many[0] = contents[0] > 1
        if group[-1] > 0 or many[group[-1]]:
            held = None
        keep = covered | many[group]
        if keep.any():
            yield run_rows(pa.array(h[keep], pa.int64(), mask=covered[keep]), b.filter(pa.array(keep)))
        if not many[group[-1]]:
            rest = (group == group[-1]) & ~covered
            if rest.any():
                mine = run_rows(pa.array(h[rest]), b.filter(pa.array(rest)))
                held = mine if held is None else pa.concat_batches([held, mine])
        several = bool(many[group[-1]])
        last = (h[-1], c[-1], first_d[-1], first_start[-1])


def judge(runs: DataFrame) -> DataFrame:
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(partitions, "h").sortWithinPartitions("h", "c", "d", "start", "t").mapInArrow(judged, RUN)


class RunIndex:
    """A run-length index of a collection of byte strings: the runs of its Burrows-Wheeler transform, and samples at their ends.

    Suffixes end with their string; a string's end is less than all bytes, and ends are in the order of the strings.
    The transform is (symbol, run length) for each run; -1 stands for the beginning of a string. `sample` has in rising
    order the text positions of the symbols at the heads of runs (where one run ends and the next begins), and of each
    string's last symbol; `above` the position of the suffix that comes before each of these in order (-1: none), and
    `match` how long both agree.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: the strings one after another; ends: for each position where its string ends."""
        self.data, self.ends, n = data, ends, len(data)
        order = self._suffixes()
        begins = np.concatenate([[True], ends[1:] != ends[:-1]])
        before = np.where(begins[order], -1, data[order - 1].astype(np.int16))
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.symbol, self.run = before[heads], np.diff(np.append(heads, n))
        sampled = np.zeros(n, dtype=bool)
        sampled[order[heads[self.symbol >= 0]] - 1] = True
        sampled[ends - 1] = True
        self.sample = np.flatnonzero(sampled)
        above = np.empty(n, dtype=np.int64)
        above[order[1:]], above[order[0]] = order[:-1], -1
        self.above = above[self.sample]
        self.match = self._agreement(self.sample, self.above)

    def _suffixes(self) -> np.ndarray:
        """Positions in the order of their suffixes, by doubling."""
        n = len(self.data)
        left = self.ends - np.arange(n)
        rank, size = np.zeros(n, dtype=np.int64), 0
        while size < 7:  # seven symbols of nine bits; 0 is the end
            symbol = np.zeros(n, dtype=np.int64)
            symbol[: n - size] = self.data[size:].astype(np.int64) + 1
            rank = rank << 9 | np.where(left > size, symbol, 0)
            size += 1
        longest = int(left.max(initial=0))
        while True:
            order = np.argsort(rank)  # not stable, so faster; ranks do not depend on the order of equal ones
            sorted_ = rank[order]
            new = np.concatenate([[False], sorted_[1:] != sorted_[:-1]])
            ranked = np.empty(n, dtype=np.int64)
            ranked[order] = np.cumsum(new) + 1
            if new[1:].all():
                return order
            if size >= longest:
                return np.argsort(ranked, kind="stable")  # equal suffixes are in the order of their places
            after = np.zeros(n, dtype=np.int64)
            after[: n - size] = ranked[size:]
            rank = ranked * (n + 2) + np.where(left > size, after, 0)
            size *= 2

    def _agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common; 0 where b is -1."""
        most = np.where(b >= 0, np.minimum(self.ends[a] - a, self.ends[b] - b), 0)
        agreed, open_ = np.zeros(len(a), dtype=np.int64), np.flatnonzero(most > 0)
        step = np.arange(8)
        while len(open_):
            i, j, k = a[open_], b[open_], agreed[open_]
            room = np.minimum(8, most[open_] - k)
            x = self.data[np.minimum((i + k)[:, None] + step, len(self.data) - 1)]
            y = self.data[np.minimum((j + k)[:, None] + step, len(self.data) - 1)]
            same = (x == y) & (step < room[:, None])
            run = np.where(same.all(1), 8, np.argmin(same, axis=1))
            agreed[open_] += run
            open_ = open_[(run == 8) & (agreed[open_] < most[open_])]
        return agreed

    def matching_statistics(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For the positions from begin to end: the position of the suffix before each one in order (-1: none), and how long both agree.

        If the symbol at i is inside a run, the suffix before i is the one before i + 1 moved by one, and they agree in one
        byte more; so the next sampled position gives both.
        """
        at = np.arange(begin, end)
        k = np.searchsorted(self.sample, at)
        far = self.sample[k] - at
        return np.where(self.above[k] >= 0, self.above[k] - far, -1), np.where(self.above[k] >= 0, self.match[k] + far, 0)


def repeats(data: np.ndarray, ends: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Positions of a collection whose string of `length` bytes stands earlier as well; order: for each position its place in time (equal: neither is earlier)."""
    index, n = RunIndex(data, ends), len(data)
    above = np.full(n, -1, dtype=np.int64)
    for at in range(0, n, STRETCH):
        source, size = index.matching_statistics(at, min(n, at + STRETCH))
        above[at : at + STRETCH] = np.where(size >= length, source, -1)
    # Chains of positions with one string: each points to its predecessor, the first to itself.
    root = np.where(above >= 0, above, np.arange(n))
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, order)
    return np.flatnonzero(order > least[root])


def contents(texts: DataFrame, length: int) -> DataFrame:
    """Of texts (d, t, text, runs array<struct<h, start, strings>>): (h, d, t, start, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, text, runs in zip(*(b.column(x).to_pylist() for x in ("d", "t", "text", "runs"))):
                data = text.encode("utf-8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["h"] for r in runs], pa.int64()), pa.array([d] * len(runs), pa.int64()), pa.array([t] * len(runs), pa.int64()), pa.array([r["start"] for r in runs], pa.int32()),
                        pa.array([data[r["start"] : r["start"] + r["strings"] + length - 1] for r in runs], pa.binary()),
                    ],
                    names=["h", "d", "t", "start", "content"],
                )

    return texts.select("d", "t", "text", "runs").mapInArrow(run, "h long, d long, t long, start int, content binary")


def blocks_of(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Of contents (h, d, t, start, content): the blocks of their runs, as RUN rows under an anchor and a distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int, int, int]] = []
            for h, d, t, start, content in zip(*(b.column(x).to_pylist() for x in ("h", "d", "t", "start", "content"))):
                n = len(content) - length + 1
                place = int(leftmost_least(gram_hashes(np.frombuffer(content, dtype=np.uint8)[:length], gram), length - gram + 1)[0])
                low = 0
                while low < n:
                    far = (place - low) // BLOCK
                    high = min(n, place - far * BLOCK + 1)  # all strings of a block are as many blocks away from the anchor
                    name = xxhash.xxh3_64_intdigest(b"%d %d" % (h, far))
                    out.append((name, xxhash.xxh3_64_intdigest(content[low : high + length - 1]), d, t, start + low, high - low))
                    low = high
            h, c, d, t, start, strings = zip(*out) if out else ((),) * 6
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([signed(h), signed(c), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(strings, pa.int32())], names=["h", "c", "d", "t", "start", "strings"])

    return rows.select("h", "d", "t", "start", "content").mapInArrow(run, RUN)


def strings_of(rows: DataFrame, length: int) -> DataFrame:
    """Of (d, t, pieces array<struct<start, content>>, runs array<struct<start, strings>> in them): each string of the runs as a RUN row of its own, known by its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, pieces, runs in zip(*(b.column(x).to_pylist() for x in ("d", "t", "pieces", "runs"))):
                pieces.sort(key=lambda x: x["start"])
                starts, at, digests = [x["start"] for x in pieces], [], []
                for r in runs:
                    piece = pieces[bisect_right(starts, r["start"]) - 1]  # runs of a text do not overlap
                    for i in range(r["start"], r["start"] + r["strings"]):
                        at.append(i)
                        digests.append(xxhash.xxh3_128_digest(piece["content"][i - piece["start"] : i - piece["start"] + length]))
                both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([d] * n, pa.int64()), pa.array([t] * n, pa.int64()), pa.array(at, pa.int32()), pa.array(np.ones(n, dtype=np.int32))], names=["h", "c", "d", "t", "start", "strings"])

    return rows.select("d", "t", "pieces", "runs").mapInArrow(run, RUN)


def bucket_repeats(length: int):
    """Rows (bucket, d, start, t, h, content) sorted by bucket, d and start in; (d, t, start, strings) of repeated strings out. Holds one bucket and one batch."""

    def marked(d: np.ndarray, t: pa.Array, start: np.ndarray, h: np.ndarray, content: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in content], dtype=np.int64)
        bounds = np.cumsum(sizes)
        ends = np.repeat(bounds, sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.arange(len(row)) - (bounds - sizes)[row]
        # Rows are sorted by (d, start of the run); places in time are ranks of (d, start of the string).
        document = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]]))
        order = document[row] * (1 << 32) + start[row] + inside
        again = repeats(np.frombuffer(b"".join(content), dtype=np.uint8), ends, order, length)
        if not len(again):
            return
        head = np.flatnonzero(np.concatenate([[True], (again[1:] != again[:-1] + 1) | (row[again[1:]] != row[again[:-1]])]))
        first, n = again[head], np.diff(np.append(head, len(again)))
        of = row[first]
        yield pa.RecordBatch.from_arrays([pa.array(d[of]), t.take(pa.array(of)), pa.array((start[of] + inside[first]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["d", "t", "start", "strings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                yield from marked(rows["d"].to_numpy(), rows["t"].combine_chunks(), rows["start"].to_numpy(), rows["h"].to_numpy(), rows["content"].to_pylist())
                held.clear()

        for b in batches:
            at = b.column("bucket").to_numpy()
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if at[low] != bucket:
                    yield from done()
                    bucket = at[low]
                held.append(b.slice(low, high - low))
        yield from done()

    return run


def kept_parts(texts: DataFrame, length: int) -> DataFrame:
    """Of texts (doc_id, text, times, marks array<struct<start, strings>> or null): (doc_id, n_bytes, n_removed, n_spans, kept_sha256, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, marks in zip(b.column("text").to_pylist(), b.column("marks").to_pylist()):
                data = text.encode("utf-8")
                spans: list[list[int]] = []
                for start, end in sorted((m["start"], m["start"] + m["strings"] + length - 1) for m in marks or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                digest, at = sha256(), 0
                for start, end in spans:
                    digest.update(data[at:start])
                    at = end
                digest.update(data[at:])
                out.append((len(data), sum(z - a for a, z in spans), len(spans), digest.hexdigest()))
            size, removed, number, digests = zip(*out) if out else ((), (), (), ())
            counts = [pa.array(x, pa.int64()) for x in (size, removed, number)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digests, pa.string()), b.column("times")], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "times"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "times", "marks").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, times long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, crowd: int = CROWD) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if gram & (gram - 1) or not gram <= length:
        raise ValueError("gram must be a power of two and not exceed length")
    spark = prepare(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text, last = F.coalesce(F.col("text"), F.lit("")), F.lit((1 << 63) - 1)
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), last).alias("d"), text.alias("text"))
    named = named.select("*", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), F.col("text")).alias("t2"), F.lit(1).cast("long").alias("times"))
    rows = materialize(named.select("d", "t", "t2"), "names")
    hot = materialize(rows.groupBy("t", "t2").agg(F.min("d").alias("least"), F.count("*").alias("n")).where(F.col("n") > rows.count() // partitions + 1), "hot_texts")
    texts, done = named.drop("t2"), None
    if not hot.isEmpty():
        # Fewer texts than partitions: each stays once, for its smallest doc_id; rows of larger ones are whole copies.
        among = named.join(F.broadcast(hot), ["t", "t2"])
        first = rows.join(F.broadcast(hot), ["t", "t2"]).where("d = least").groupBy("t", "t2").agg(F.count("*").alias("times"))
        once = among.where("d = least").drop("times").dropDuplicates(["t", "t2"]).join(first, ["t", "t2"])
        texts = materialize(named.join(F.broadcast(hot), ["t", "t2"], "left_anti").select(*texts.columns).unionByName(once.select(*texts.columns)), "texts")
        size = F.octet_length("text").cast("long")
        long_ = size >= length
        done = among.where("d > least").select(
            "doc_id", size.alias("n_bytes"), F.when(long_, size).otherwise(0).alias("n_removed"), F.when(long_, 1).otherwise(0).cast("long").alias("n_spans"), F.sha2(F.when(long_, "").otherwise(F.col("text")), 256).alias("kept_sha256")
        )
    found = materialize(judge(find_runs(texts, length, gram)), "judged")
    marks = found.where("h IS NULL").select("d", "t", "start", "strings")
    alike = materialize(contents(with_runs(texts, found.where("h IS NOT NULL"), "inner", "h", "start", "strings"), length), "contents")
    sizes = materialize(alike.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes")), "anchors")
    many = sizes.where(F.col("n") > crowd)
    if not many.isEmpty():
        parted = materialize(looked_up(alike, many.select("h", F.lit(True).alias("crowded")), "h", sizes.select("h", "n")), "crowded")
        alike, crowded = parted.where("crowded IS NULL"), parted.where("crowded")
        blocks = materialize(judge(blocks_of(crowded, length, gram)), "blocks")
        pieces = crowded.groupBy("d", "t").agg(F.collect_list(F.struct("start", "content")).alias("pieces"))
        mixed = blocks.where("h IS NOT NULL").groupBy("d", "t").agg(F.collect_list(F.struct("start", "strings")).alias("runs"))
        each = materialize(judge(strings_of(pieces.join(mixed, ["d", "t"]), length)), "strings")
        covered = lambda x: x.where("h IS NULL").select("d", "t", "start", "strings")
        marks = marks.unionByName(covered(blocks)).unionByName(covered(each))
    buckets = max(1, math.ceil((sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0) / bucket_bytes))
    dealt = alike.select("h", "d", "t", "start", "content", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int").alias("bucket"))
    sorted_ = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "d", "start", "t")
    marks = marks.unionByName(sorted_.mapInArrow(bucket_repeats(length), "d long, t long, start int, strings int"))
    whole = kept_parts(with_runs(texts, materialize(marks, "marks"), "left", "start", "strings"), length)
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("copy", "times")
    return whole if done is None else whole.unionByName(done)


def with_runs(texts: DataFrame, runs: DataFrame, how: str, *columns: str) -> DataFrame:
    """texts (d, t, text) with the array of their own runs or marks, which is no longer than the text."""
    name = "runs" if "h" in columns else "marks"
    lists = runs.groupBy("d", "t").agg(F.collect_list(F.struct(*columns)).alias(name))
    return texts.join(lists.hint("shuffle_hash"), ["d", "t"], how)
