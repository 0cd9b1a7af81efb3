"""Source divergence audit: how far the word use of each source of a language lies from that of the others.

Term counts of (lang, source) groups form a sparse matrix, whose columns are dealt to bands of about `band` terms and
whose rows to blocks of `block` groups. A cell of the work is one band with two blocks. In it a K-squared tree keeps
the nonzero entries: each level splits a square into K x K quadrants, and a quadrant without entries ends there. All
pairs of groups walk the tree together from its root: where the quadrants of both groups are empty, all their columns
are priced at once, as the two shares of an unseen term differ by the same amount everywhere; only leaves with an entry
are priced one by one. Columns are ordered by the groups that hold them, so that empty quadrants are large. Terms that
no group of a cell holds never reach it; they are priced in the same way when the cells are added up.

Shares are whole billionths, made from decimal numbers, so nothing is rounded whatever the counts.

Defined results: null text, lang and source are ''; a language whose terms are all too rare has pairs of value 0 and no
terms; a language with one source has no pairs; groups without terms are there; each repeated row counts; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm._common import materialize, pieces, prepare

#: Runs of letters in the lower-cased (A-Z) UTF-8 text: ASCII letters and all that is not ASCII.
TERM, BREAK = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")
#: Different terms that a task holds before it passes their counts on.
HELD = 200_000
#: Terms of a band, groups of a block, the tree's fan-out on each side, and pairs that walk together.
BAND, BLOCK, K, WALK = 8192, 128, 4, 512
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within tasks; a row without a term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in counts.items():
                terms = [None, *(t.decode("utf-8") for t in n)]
                size = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(held[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            counts.clear()

        for b in batches:
            for text, lang, source in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), b.column("source").to_pylist()):
                n, held = counts.setdefault((lang, source), (Counter(), Counter()))
                mine: Counter = Counter()
                for piece in pieces(text.encode("utf-8").lower(), BREAK):
                    mine.update(TERM.findall(piece))
                n.update(mine)
                held.update(mine.keys())
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from passed()
        yield from passed()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)) in decimal numbers."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = (wide(total) + wide(terms) * F.lit(smooth).cast("decimal(3,0)")).cast("decimal(22,0)")
    top = ((wide(count) + F.lit(smooth)).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")).cast("decimal(31,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, over)


class SquareTree:
    """A K-squared tree of a sparse matrix: for each level the K * K quadrants of each nonempty one, and the number of nonempty ones before it."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, width: int, fan: int = K):
        self.fan, self.width, self.side = fan, width, fan
        while self.side < max(width, int(row.max(initial=0)) + 1):
            self.side *= fan
        at, size = np.zeros(len(row), dtype=np.int64), self.side
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = 1
        while size > 1:
            size //= fan
            code = at * fan * fan + (row // size % fan) * fan + col // size % fan
            bits = np.zeros(nodes * fan * fan, dtype=bool)
            bits[code] = True
            before = np.cumsum(bits) - bits  # the rank of each nonempty quadrant is its number one level down
            self.levels.append((bits, before))
            at, nodes = before[code], int(bits.sum())
        self.leaves = np.zeros(nodes, dtype=np.int64)
        self.leaves[at] = value

    def child(self, level: int, node: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number of the quadrant at `place` of each node, -1 where it or the node itself is empty."""
        bits, before = self.levels[level]
        code = np.maximum(node, 0) * self.fan * self.fan + place
        return np.where((node >= 0) & bits[code], before[code], -1)


def pair_sums(tree: SquareTree, g: np.ndarray, h: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """For each pair of rows the sum over all columns of the absolute difference of their shares; unseen: a row's share of a term that it lacks."""
    out, gap = np.zeros(len(g), dtype=np.int64), np.abs(unseen[g] - unseen[h])
    pair, a, b, start = np.arange(len(g)), np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int64), np.zeros(len(g), dtype=np.int64)
    size, fan = tree.side, tree.fan
    for level in range(len(tree.levels)):
        size //= fan
        step = np.arange(fan)
        of_g = tree.child(level, a[:, None], (g[pair] // size % fan * fan)[:, None] + step)
        of_h = tree.child(level, b[:, None], (h[pair] // size % fan * fan)[:, None] + step)
        begin = start[:, None] + step * size
        empty = (of_g < 0) & (of_h < 0)
        columns = np.where(empty, np.clip(tree.width - begin, 0, size), 0).sum(1)
        np.add.at(out, pair, columns * gap[pair])
        more = ~empty
        pair, a, b, start = np.repeat(pair, more.sum(1)), of_g[more], of_h[more], begin[more]
    left, right = np.where(a >= 0, tree.leaves[a], unseen[g[pair]]), np.where(b >= 0, tree.leaves[b], unseen[h[pair]])
    np.add.at(out, pair, np.abs(left - right))
    return out


def by_holders(row: np.ndarray, col: np.ndarray, width: int) -> np.ndarray:
    """A new place for each column, so that columns that the same rows hold stand together."""
    held = np.zeros((width, int(row.max(initial=0)) // 8 + 1), dtype=np.uint8)
    np.bitwise_or.at(held, (col, row // 8), (128 >> (row % 8)).astype(np.uint8))
    place = np.empty(width, dtype=np.int64)
    place[np.lexsort(held.T[::-1])] = np.arange(width)
    return place


def cell_sums(rows: pa.Table) -> pa.Table:
    """A band with two blocks of groups: rows (lang, first, second, number, term, p, unseen; a null term names a group) to (lang, g, h, total, terms)."""
    number, p, unseen = (rows[c].to_numpy() for c in ("number", "p", "unseen"))
    first, second = rows["first"][0].as_py(), rows["second"][0].as_py()
    groups, at = np.unique(number, return_inverse=True)
    seen = np.zeros(len(groups), dtype=np.int64)
    seen[at] = unseen
    entry = ~rows["term"].is_null().to_numpy()
    terms = rows["term"].filter(pa.array(entry)).combine_chunks().dictionary_encode()
    col, width = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
    row = at[entry]
    tree = SquareTree(row, by_holders(row, col, width)[col], p[entry], width)
    i, j = np.nonzero((groups[:, None] // BLOCK == first) & (groups[None, :] // BLOCK == second) & (groups[:, None] < groups[None, :]))
    total = np.concatenate([pair_sums(tree, i[k : k + WALK], j[k : k + WALK], seen) for k in range(0, len(i), WALK)] or [np.zeros(0, dtype=np.int64)])
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(i), pa.string()), "g": groups[i], "h": groups[j], "total": total, "terms": np.full(len(i), width, dtype=np.int64)})


def divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, scale: int = 1_000_000_000, top: int = 50) -> DataFrame:
    """docs (text, lang, source, ...): lang, source, part (pair, term), item, value, rank; terms count that at least min_docs documents of their language hold."""
    prepare(docs.sparkSession)
    counted = materialize(term_counts(docs).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    held = materialize(counted.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "held")
    # Every kept term of a language is in held; its languages and groups are small tables beside it.
    langs = held.groupBy("lang", "term").agg(F.max("in_lang").alias("in_lang")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    sums = held.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    numbers = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counted.where("term IS NULL").select(*GROUP).withColumn("number", numbers).join(sums, GROUP, "left").join(langs, "lang", "left")
    none = F.lit(0).cast("long")
    groups = groups.withColumns({"total": F.coalesce("total", none), "terms": F.coalesce("terms", none), "lang_total": F.coalesce("lang_total", none)})
    unseen = F.when(F.col("terms") > 0, share(none, F.col("total"), F.col("terms"), smooth, scale)).otherwise(none)
    groups = materialize(groups.withColumn("unseen", unseen).withColumn("blocks", F.floor(F.max("number").over(Window.partitionBy("lang")) / BLOCK).cast("int") + 1), "groups")
    shares = held.join(groups, GROUP).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"), smooth, scale))

    bands = F.ceil(F.col("terms") / BAND).cast("int")
    block = F.floor(F.col("number") / BLOCK).cast("int")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(block, o).alias("first"), F.greatest(block, o).alias("second"))))
    entries = shares.select("lang", F.pmod(F.xxhash64("term"), bands).cast("int").alias("band"), meets.alias("at"), "number", "term", "p", "unseen")
    every = groups.where("terms > 0").select("lang", F.explode(F.sequence(F.lit(0), bands - 1)).alias("band"), "number", "unseen", "blocks").select("lang", "band", meets.alias("at"), "number", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), "unseen")
    cells = entries.unionByName(every).select("lang", "band", "at.first", "at.second", "number", "term", "p", "unseen")
    sums_of_cells = cells.groupBy("lang", "band", "first", "second").applyInArrow(cell_sums, "lang string, g int, h int, total long, terms long")
    priced = sums_of_cells.groupBy("lang", "g", "h").agg(F.sum("total").alias("total"), F.sum("terms").alias("seen"))

    one = lambda n: groups.select("lang", F.col("source").alias(f"{n}_source"), F.col("number").alias(n), F.col("unseen").alias(f"{n}_unseen"), *(["terms"] if n == "g" else []))
    # One row for each pair of a language's groups: they are the result.
    both = one("g").join(one("h"), "lang").where("g < h").join(priced, ["lang", "g", "h"], "left")
    rest = (F.col("terms") - F.coalesce("seen", none)) * F.abs(F.col("g_unseen") - F.col("h_unseen"))
    valued = both.select("lang", "g_source", "h_source", (F.coalesce("total", none) + rest).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("g_source").alias("source"), F.col("h_source").alias("item")), F.struct(F.col("h_source").alias("source"), F.col("g_source").alias("item"))))
    pairs = valued.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    above = shares.withColumn("value", F.col("p") - share(F.col("in_lang"), F.col("lang_total"), F.col("terms"), smooth, scale)).where("n > 0 AND value > 0")
    terms = above.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= top))
