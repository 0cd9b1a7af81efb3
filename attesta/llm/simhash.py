"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by tiled exact comparison.

Equal fingerprints are one node. Two that differ in at most `radius` bits share at least bands - radius of `bands` bit
bands, so every pair of nodes that can link meets in a block keyed by such bands; nothing else is compared. Blocks with
more than TILE nodes are cut into tiles by population count and hash, and only tile pairs whose population counts lie
within the radius meet. Inside a tile (pair) numpy's exclusive-or and bit counts compare all rows exactly; a tile
returns a spanning forest of its links, never all pairs. Components follow from alternating stars over the forests.

To keep one document of each group of near copies (five words, a similarity of 0.8), 64 bits are too coarse: texts of
that similarity differ in 5 to 15 of them, and so do unrelated texts of a large corpus. `keep_one` therefore compares
fingerprints of WIDE bits over the distinct shingles, in blocks keyed by prefixes: with all shingles in one order, two
sets of similarity s share one of the first n - ceil(s * n) + 1 of each, so no pair is missed, whatever the order. The
order is by a count of COUNTERS slots that the shingles of all texts fall in, least first, so that passages of very many
texts are in the prefix of those alone that hold little else. Blocks that have the same smallest node are one. Pairs
within the `sure` radius link at once (as a forest). Pairs between that and the `doubtful` radius link if the shingle
sets themselves are as similar as asked: the cell names the rows in doubt, their sets are brought to it, and pairs that
links have not joined already are compared there. Both radii lie MARGIN deviations from the mean at that similarity: a
pair is misjudged with a probability of about 1e-12. Fingerprints of a few shingles scatter more, so pairs with a text
of up to SMALL shingles never link unseen and have a wider doubtful radius. Only forests leave a cell, never pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; repeated rows have equal rows in the result; a null doc_id is never the
smallest of its component (null if all are null); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._common import materialize, prepare
from attesta.sources.scratch import last_table, release

TILE, SHORT = 2048, 8
#: Of wide fingerprints: bits, nodes of a tile, and shingles in the sets that a tile of verification holds.
WIDE, WIDE_TILE, TILE_SHINGLES = 1024, 2048, 4 << 20
#: Shingles of a small text, and the doubtful radius of such: above the mean of four and five shingles, the pair at 0.8 that scatters most, by as many deviations.
SMALL, SMALL_RADIUS = 25, 296
#: Deviations from the mean number of differing bits that the sure radius lies below and the doubtful one above.
MARGIN = 7
#: Slots that shingles are counted in, a power of two: what is broadcast is this large, whatever the table.
COUNTERS = 1 << 20
#: Odd multipliers that make further hashes out of one.
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, size=WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The most parts that the rows of one key are dealt to.
MAX_SALTS = 64


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 values (seed 42) of the lower-cased (A-Z) text's shingles, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        spans = zip(starts[: 1 - shingle].tolist() if shingle > 1 else starts.tolist(), ends[shingle - 1 :].tolist())
        return np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8")
    return np.array([digest(joined, 42)], dtype="<u8")


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE bits as uint64 words: bit b is 1 if set in over half of the distinct shingles' hashes."""
    counts = np.zeros(WIDE, dtype=np.int64)
    for at in range(0, len(hashes), 4080):
        x = hashes[at : at + 4080, None] * _MULTIPLIERS
        x ^= x >> np.uint64(32)
        x *= _MULTIPLIERS[:1]
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # 255 ones fit a byte
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def slots_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


def prefix_of(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of distinct hashes those of which any set of that similarity has one in its own prefix: the first ones by count, then hash."""
    n = len(hashes)
    size = min(n, n - math.ceil(similarity * n - 1e-9) + 1)
    return hashes[np.lexsort((hashes, counts[slots_of(hashes, len(counts))]))[:size]]


def shingle_counts(docs: DataFrame, shingle: int = 5) -> np.ndarray:
    """In how many texts of docs (text) the distinct shingles of each of COUNTERS slots are; a task adds up its own first."""
    slots = COUNTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, dtype=np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                np.add.at(total, slots_of(np.unique(shingle_hashes(text, shingle)), slots), 1)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 65536):
            part = used[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    got = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    counts = np.zeros(slots, dtype=np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    return counts


def wide_radius(similarity: float, deviations: float) -> int:
    """Bits in which wide fingerprints of two equally large shingle sets of that similarity differ: the mean and so many deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(WIDE * p + deviations * math.sqrt(WIDE * p * (1 - p)))


def with_wide_fingerprints(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of docs (doc_id, row_key, text): doc_id, row_key, a name `fp` of the set of shingles, its wide fingerprint `bits` (binary), their population count `ones`, block `keys` (its prefix), and `n` distinct shingles."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                hashes = np.unique(shingle_hashes(text, shingle))
                bits = wide_fingerprint(hashes)
                keys = prefix_of(hashes, counts.value, similarity)
                rows.append((xxhash.xxh64_intdigest(hashes.tobytes(), 7), bits.tobytes(), int(np.bitwise_count(bits).sum()), keys.view(np.int64), len(hashes)))
            fp, bits, ones, keys, n = zip(*rows) if rows else ((),) * 5
            columns = [pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(ones, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), *columns], names=["doc_id", "row_key", "fp", "bits", "ones", "keys", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {kind}, row_key string, fp long, bits binary, ones int, keys array<long>, n int")


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and the fingerprint as a signed long `fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint_of(t, shingle) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits that differ, over the last axis of uint64 words."""
    total = np.bitwise_count(x[..., 0] ^ y[..., 0])
    if x.shape[-1] > 1:
        total = total.astype(np.uint16)
        for w in range(1, x.shape[-1]):
            total += np.bitwise_count(x[..., w] ^ y[..., w])
    return total


def forest_of(fps: np.ndarray, sure: np.ndarray, doubtful: np.ndarray, side: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (row, row) that connect what lies within the sure radius in fps (rows of uint64 words), as few as a spanning forest has.

    Then the pairs (row, row) beyond that and within the doubtful radius that the forest does not connect. Each row has
    its radii; a pair has the smaller sure one and the larger doubtful one.
    """
    count = np.bitwise_count(fps).sum(1, dtype=np.int32)
    order = np.argsort(count, kind="stable")
    x, ones, low, high = fps[order], count[order], sure[order], doubtful[order]
    reach = max(int(low.max(initial=0)), int(high.max(initial=0)))
    label = np.arange(len(x))
    left, right = [], []
    for a in range(0, len(x), side):
        for b in range(a, len(x), side):
            if ones[b] - ones[min(a + side, len(x)) - 1] > reach:
                break  # sorted by population count: all later tiles differ by more as well
            far = differing(x[a : a + side, None], x[None, b : b + side])
            near = far <= np.minimum(low[a : a + side, None], low[None, b : b + side])
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            i, j = i[i < j], j[i < j]
            while len(i):
                least = np.minimum(label[i], label[j])
                np.minimum.at(label, label[i], least)
                np.minimum.at(label, label[j], least)
                label = label[label]
                if (label[i] == label[j]).all():
                    break
            if high.any():
                i, j = np.nonzero(~near & (far <= np.maximum(high[a : a + side, None], high[None, b : b + side])))
                i, j = i + a, j + b
                apart = (i < j) & (label[i] != label[j])
                left.append(i[apart])
                right.append(j[apart])
    while (label[label] != label).any():
        label = label[label]
    child = np.flatnonzero(label != np.arange(len(x)))
    i, j = (np.concatenate(z) if z else child[:0] for z in (left, right))
    apart = label[i] != label[j]
    return order[child], order[label[child]], order[i[apart]], order[j[apart]]


def radii(sizes: np.ndarray, sure: int, doubtful: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's radii by its number of distinct shingles; a text about as large as a small one counts as small."""
    small = sizes < 2 * SMALL
    return np.where(small, 0, sure), np.where(small, max(SMALL_RADIUS, doubtful), doubtful)


def compare_cells(radius: int, words: int = 0, doubtful: int = 0):
    """Rows (cell, fp) sorted by cell in, links (a, b, sure) out; holds one cell and one batch at a time.

    With `words` the fingerprints are as many uint64 words in the binary column `bits`, fp is only their name, and `n` the
    number of shingles, from which the radii follow. Links within the radius are sure. Rows that are not sure are
    (cell, fp): fp has a pair within the doubtful radius that the cell's sure links do not connect.
    """

    def links(cell: np.ndarray, fp: np.ndarray, bits: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        low, high = radii(size, radius, doubtful) if words else (np.full(len(fp), radius), np.zeros(len(fp), dtype=int))
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        sizes = np.diff(edge)
        for at, n in zip(edge[:-1][sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            names, row = np.unique(fp[at : at + n], return_index=True)
            row += at
            i, j, k, m = forest_of(bits[row], low[row], high[row])
            yield names[i], names[j], True
            rows = np.unique(np.concatenate([k, m]))
            yield np.full(len(rows), cell[at]), names[rows], False
        short = np.repeat(sizes <= SHORT, sizes)
        cell, fp, bits, low, high = cell[short], fp[short], bits[short], low[short], high[short]
        for d in range(1, min(SHORT, len(fp))):
            same = cell[d:] == cell[:-d]
            u, v = fp[d:][same], fp[:-d][same]
            if not len(u):
                break
            far = differing(bits[d:][same], bits[:-d][same])
            near = (far <= np.minimum(low[d:][same], low[:-d][same])) & (u != v)
            yield u[near], v[near], True
            if words:
                doubt = ~near & (far <= np.maximum(high[d:][same], high[:-d][same])) & (u != v)
                yield np.tile(cell[d:][same][doubt], 2), np.concatenate([u[doubt], v[doubt]]), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out(columns):
            for u, v, sure in links(*columns):
                if len(u):
                    a, b = (np.minimum(u, v), np.maximum(u, v)) if sure else (u, v)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(u), sure))], names=["a", "b", "sure"])

        for batch in batches:
            cell, fp = batch.column("cell").to_numpy(), batch.column("fp").to_numpy()
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype="<u8").reshape(-1, words) if words else fp.view(np.uint64).reshape(-1, 1)
            parts.append((cell, fp, bits, batch.column("n").to_numpy() if words else cell))
            held += len(cell)
            if held > 65536:
                columns = [np.concatenate(x) for x in zip(*parts)]
                last = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last cell may go on in the next batch
                if last:
                    yield from out([x[:last] for x in columns])
                parts, held = [tuple(x[last:] for x in columns)], held - last
        if held:
            yield from out([np.concatenate(x) for x in zip(*parts)])

    return run


def cells_of(placed: DataFrame, radius: int, keep: list[str], striped: bool = True) -> DataFrame:
    """Placed nodes (fp, block, ones, parts, ...) in the cells where they are compared: cell and the columns to keep.

    A block without parts is one cell. A node of a large block meets its own tile and, if striped, every tile of the
    stripes of one population count that lie within the radius; else every tile of the block (for fingerprints so wide
    that all counts lie within the radius).
    """
    tile = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    tiles = F.sequence(F.lit(0), F.col("parts") - 1)
    mine, others = tile, tiles
    if striped:
        mine = F.col("ones") * 65536 + tile
        stripes = F.sequence(F.greatest(F.col("ones") - radius, F.lit(0)), F.col("ones") + radius)
        others = F.flatten(F.transform(stripes, lambda p: F.transform(tiles, lambda t: p * 65536 + t)))
    pairs = F.transform(others, lambda o: F.xxhash64(F.col("block"), F.least(mine, o), F.greatest(mine, o)))
    return placed.select(F.explode(F.when(F.col("parts").isNull(), F.array("block")).otherwise(pairs)).alias("cell"), *keep)


def near_links(nodes: DataFrame, radius: int, bands: int = 6) -> DataFrame:
    """Distinct links (a, b) between fingerprints of nodes (fp) whose closure is that of all pairs within radius bits."""
    keep = bands - radius
    if keep < 1:
        raise ValueError("bands must exceed radius")
    cuts = [round(i * 64 / bands) for i in range(bands + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(bands), keep)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    block = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed))))
    blocks = nodes.select("fp", block.alias("block"))
    large = blocks.groupBy("block").count().where(F.col("count") > TILE).select("block", F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    placed = blocks.join(large, "block", "left").withColumn("ones", F.bit_count("fp"))
    cells = cells_of(placed, radius, ["fp"])
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(compare_cells(radius), "a long, b long, sure boolean").select("a", "b").distinct()


def wide_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Of nodes (fp, bits, ones, keys, n) that share a block: sure links (a, b, true) up to closure, and (cell, fp, false) for nodes in doubt."""
    sure, doubtful = wide_radius(similarity, -MARGIN), wide_radius(similarity, MARGIN)
    blocks = nodes.select("fp", F.explode("keys").alias("key"))
    # Near copies share most of their blocks; those with one smallest node are one block, so that its nodes meet once.
    shared = blocks.groupBy("key").agg(F.min("fp").alias("block"), F.count("*").alias("n")).where("n > 1").select("key", "block")
    joined = materialize(blocks.join(shared, "key").select("fp", "block").distinct(), "blocks")
    large = joined.groupBy("block").count().where(F.col("count") > WIDE_TILE).select("block", F.ceil(F.col("count") / WIDE_TILE).cast("int").alias("parts"))
    placed = joined.join(large, "block", "left").join(nodes.select("fp", "bits", "ones", "n"), "fp")
    cells = cells_of(placed, 0, ["fp", "bits", "n"], striped=False)
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(compare_cells(sure, WIDE // 64, doubtful), "a long, b long, sure boolean")
    return found.distinct()


def alike_links(doubt: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of doubt (cell, fp, bits, root, first_id, parts) of docs (row_key, text): links (a, b) up to closure between rows of a cell whose shingle sets are that similar.

    A task holds one cell, about two tiles of WIDE_TILE rows at most, with their sets. A cell whose sets are large comes in
    parts, and each two parts meet in a cell of their own.
    """
    doubtful = wide_radius(similarity, MARGIN)
    named = doubt.select("fp", F.col("first_id.row_key").alias("row_key")).dropDuplicates(["fp"])
    texts = docs.select("row_key", "text").join(named, "row_key").select("fp", "text").dropDuplicates(["fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(grams, pa.binary())], names=["fp", "grams"])

    def alike(rows: pa.Table) -> pa.Table:
        side = 512
        fp, bits = rows["fp"].to_numpy(), np.frombuffer(b"".join(rows["bits"].to_pylist()), dtype="<u8").reshape(len(rows), -1)
        grams = [np.frombuffer(x, dtype="<u8") for x in rows["grams"].to_pylist()]
        sizes = np.array([len(g) for g in grams])
        high = radii(sizes, 0, doubtful)[1]
        label = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        found = []
        for a in range(0, len(fp), side):
            for b in range(a, len(fp), side):
                near = differing(bits[a : a + side, None], bits[None, b : b + side]) <= np.maximum(high[a : a + side, None], high[None, b : b + side])
                i, j = np.nonzero(near)
                i, j = i + a, j + b
                apart = (i < j) & (label[i] != label[j]) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]))
                for u, v in zip(i[apart].tolist(), j[apart].tolist()):
                    if label[u] != label[v]:
                        both = len(np.intersect1d(grams[u], grams[v], assume_unique=True))
                        if both >= similarity * (len(grams[u]) + len(grams[v]) - both):
                            found.append((u, v))
                            label[label == label[v]] = label[u]
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

    grams = materialize(texts.mapInArrow(sets, "fp long, grams binary"), "grams")
    mine = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("cell", F.least(mine, o), F.greatest(mine, o)))
    cells = doubt.select(F.explode(meets).alias("cell"), "fp", "bits", "root")
    return cells.join(grams, "fp").groupBy("cell").applyInArrow(alike, "a long, b long").distinct()


def salts_for(most: int, rows: int, spark) -> int:
    """To how many parts the rows of a key are dealt, so that the key with the most rows does not hold more than a task's share."""
    return max(1, min(MAX_SALTS, -(-most * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, rows))))


def dealt(rows: DataFrame, by: str, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def copied(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Of undirected links (a, b): (node, root), root the smallest node of its component. Alternating large and small stars.

    The links of a node with very many of them are dealt to several tasks.
    """
    spark = links.sparkSession
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        old = [last_table(spark)]
        both = edges.select("u", "v", F.lit(False).alias("centre")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(True).alias("centre")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"), F.max("centre").alias("centre")), "lows")
        old.append(last_table(spark))
        sizes = low.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        salts = salts_for(2 * sizes["most"], sizes["rows"], spark)
        # large star: larger neighbours go to the smallest of the neighbourhood
        around = dealt(edges.select(F.col("v").alias("u"), F.col("u").alias("w")), "w", salts)
        large = around.join(copied(low.where("centre").select("u", "m"), salts), ["u", "salt"]).select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        kept = dealt(large, "v", salts).join(copied(small_low.where("n > 1").select("u", "m"), salts), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(kept.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        release(spark, old)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, bands: int = 6) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    prepare(docs.sparkSession)
    prints = materialize(with_fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    member = members(nodes, near_links(nodes.select("fp"), radius, bands))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(member, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def members(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per node (fp, first_id) the smallest first_id of its component: (fp, component_id)."""
    spark = nodes.sparkSession
    roots = components(links)
    rooted = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    several = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "roots")
    sizes = several.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    salts = salts_for(sizes["most"], sizes["rows"], spark)
    under = dealt(rooted.where("root <> fp"), "fp", salts).join(copied(several.select("root", "least"), salts), ["root", "salt"]).select("fp", F.col("least").alias("component_id"))
    alone = rooted.where("root = fp").join(several.select("root", "least"), "root", "left").select("fp", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first_id")).alias("component_id"))
    return under.unionByName(alone)


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of docs (doc_id, row_key, text): (fp, component_id) for each different set of shingles; component_id is the first row (bare, doc_id, row_key) reachable by links between texts of that similarity.

    First is the smallest doc_id, and of rows that share it the smallest row_key; rows without a doc_id (bare) come last.
    """
    prints = with_wide_fingerprints(docs, shingle, similarity)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row_key")).alias("first_id")
    nodes = materialize(prints.groupBy("fp").agg(least, *(F.first(c).alias(c) for c in ("bits", "ones", "keys", "n"))), "nodes")
    links = materialize(wide_links(nodes, similarity), "wide_links")
    sure = components(links.where("sure").select("a", "b"))
    rooted = nodes.join(sure, nodes["fp"] == sure["node"], "left").select("fp", "bits", "n", "first_id", F.coalesce("root", "fp").alias("root"))
    doubt = links.where("NOT sure").select(F.col("a").alias("cell"), F.col("b").alias("fp")).join(rooted, "fp")
    several = doubt.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("parts")).where("low <> high").select("cell", F.greatest("parts", F.lit(1)).alias("parts"))
    verified = alike_links(materialize(doubt.join(several, "cell"), "doubt"), docs, shingle, similarity)
    return members(nodes.select("fp", "first_id"), sure.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, or without one if none of its rows has any.

    A row is told from others by its doc_id and a 128-bit hash of its text, so ids may be null or repeated.
    """
    prepare(docs.sparkSession)
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    key = F.md5(F.concat(part(F.md5("text")), F.lit("|"), part(F.col("doc_id").cast("string"))))
    groups = similar_groups(docs.select("doc_id", key.alias("row_key"), "text"), shingle, similarity)
    chosen = groups.select(F.col("component_id.row_key").alias("_row_key")).distinct()
    once = docs.withColumn("_row_key", key).dropDuplicates(["_row_key"])
    return once.join(chosen, "_row_key", "left_semi").select(*docs.columns)
