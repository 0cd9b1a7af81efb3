"""A standing index of chunks that takes in documents without being built anew.

What follows from a chunk alone (its postings, hashed weights and concepts) is kept for each chunk; what belongs to a
scope as a whole (document frequencies, number and length of chunks) is kept as sums. A version of the index holds the
new chunks' rows, what they add to the sums and what the chunks that they replace take off, and the names of the
documents replaced, whose older rows count no longer. So an upsert reads the postings of the replaced documents in
their scopes and writes rows of the new ones; the rest of the scope is not touched. Inverse document frequencies are made when they are
read, as they depend on the whole scope. compact() writes scopes as one version each. Postings, weights and concepts can be
left for `later`: the first who reads them has them made of all chunks that count, and from then on upserts write them
too. Without postings the sums are those of the texts, added up where a batch of them is.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import fixed
from attesta.functions.text import concepts
from attesta.operators.chunks import chunk_id
from attesta.operators.lanes import SCOPE, inverse_frequencies, word_sums, words_in_rows
from attesta.sources.scratch import cut, few
from attesta.sources.versions import Change, Versions, scope_key

#: Tables with rows of single chunks, and those of sums with the columns that are added up.
OF_CHUNKS = ["chunks", "postings", "weights", "concepts"]
SUMS = {"terms": ["df"], "scopes": ["n", "length"]}
#: Tables whose rows are made where the chunks of few scopes are.
PLACED = ["postings", "weights"]
PLACE = [*SCOPE, "chunk_id", "doc_id", "ordinal"]


def dealt(chunks: DataFrame, rows: int = 2_500) -> DataFrame:
    """Chunks in partitions of about 2 * rows, those of a scope in as few as hold them: texts are moved, and their many words are made and written where they are."""
    sizes = few(chunks.groupBy("scope_key").agg(F.ceil(F.count("*") / rows).alias("parts")), "sizes")
    n = max(1, -(-chunks.count() // (2 * rows)))
    part = F.pmod(F.xxhash64("chunk_id"), F.col("parts"))
    return chunks.join(sizes, "scope_key").withColumn("part", part).repartition(n, "scope_key", "part").drop("part", "parts")


@dataclass
class Index:
    store: Versions
    dim: int = 384
    mode: str = "blake2b"
    pattern: str = fixed.CONCEPT
    later: tuple[str, ...] = ()
    _gone: dict[int, bool] = field(default_factory=dict)
    _added: dict[tuple[int, str], bool] = field(default_factory=dict)

    def exists(self) -> bool:
        return self.store.state()["version"] > 0

    def live(self, name: str, scopes: DataFrame | None = None) -> DataFrame:
        """The rows that count, with scope_key; of all scopes or of some (scope_key)."""
        rows = self.store.read(name)
        if scopes is not None:
            rows = rows.join(scopes, "scope_key", "left_semi")
        if self._any_gone():
            gone = self.store.read("gone")
            gone = gone if scopes is None else gone.join(scopes, "scope_key", "left_semi")
            last = gone.groupBy("scope_key", "doc_id").agg(F.max("version").alias("until"))
            same = (rows["scope_key"] == last["scope_key"]) & (rows["doc_id"] == last["doc_id"]) & (rows["version"] < last["until"])
            rows = rows.join(last, same, "left_anti")
        return rows.drop("version")

    def _any_gone(self) -> bool:
        """Whether the current version has replaced documents at all."""
        version = self.store.state()["version"]
        if version not in self._gone:
            self._gone[version] = not self.store._manifest(version).where("name = 'gone'").isEmpty()
        return self._gone[version]

    def chunks(self) -> DataFrame:
        return self.live("chunks").drop("scope_key")

    def weights(self) -> DataFrame:
        self._make("weights")
        return self.live("weights").drop("scope_key")

    def concepts(self) -> DataFrame:
        self._make("concepts")
        return self.live("concepts").drop("scope_key")

    def _make(self, name: str) -> None:
        """A table that was left for later, as a version of its own."""
        if name in self._left():
            self.store.commit({name: Change(self._rows(self.live("chunks"), name), add=True, placed=name in PLACED)})

    def _left(self) -> list[str]:
        """The tables that are left for later and were not asked for yet."""
        have = self.store.state()["schemas"] if self.later else {}
        return [name for name in self.later if name not in have]

    def sums(self, name: str, scopes: DataFrame | None = None) -> DataFrame:
        rows = self.store.read(name)
        rows = rows if scopes is None else rows.join(scopes, "scope_key", "left_semi")
        keys = ["scope_key", *SCOPE, *(["term"] if name == "terms" else [])]
        if self._any_added(name):
            rows = rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS[name]))
        return rows.select(*keys, *SUMS[name]).where(F.col(SUMS[name][0]) > 0)

    def _any_added(self, name: str) -> bool:
        """Whether a scope has sums of several versions; those of one are added up already."""
        version = self.store.state()["version"]
        if (version, name) not in self._added:
            held = self.store._manifest(version).where(F.col("name") == name)
            self._added[version, name] = not held.groupBy("scope_key").count().where("count > 1").isEmpty()
        return self._added[version, name]

    def postings(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """postings, terms (df, idf) and scopes (n, avgdl), as build_postings() has them."""
        self._make("postings")
        return self.live("postings").drop("scope_key"), *self.frequencies()

    def frequencies(self) -> tuple[DataFrame, DataFrame]:
        """terms (df, idf) and scopes (n, avgdl) alone."""
        scopes = few(self.sums("scopes").select(*SCOPE, "n", (F.col("length") / F.col("n")).alias("avgdl")), "scopes")
        return inverse_frequencies(self.sums("terms").drop("scope_key"), scopes), scopes

    def _rows(self, chunks: DataFrame, name: str) -> DataFrame:
        """A table of single chunks for chunks with scope_key."""
        place = ["scope_key", *PLACE]
        if name == "chunks":
            return chunks
        if name == "concepts":
            return chunks.select(*place, F.explode(concepts("text", self.pattern)).alias("concept"))
        texts = dealt(chunks).select(*place, "text")
        return words_in_rows(texts) if name == "postings" else words_in_rows(texts, self.dim, self.mode)

    def upsert(self, chunks: DataFrame, removed: DataFrame | None = None, writer: str | None = None, batch: int | None = None, also: dict[str, Change] | None = None) -> int:
        """Take in chunks (chunk_pages) with all chunks of their documents; those documents, and removed ones (scope, doc_id), lose their former chunks.

        Chunks without a doc_id replace nothing; their ordinals go on from those that the scope has without one. also:
        other tables that change in the same version. A batch of a writer that was taken in before changes nothing.
        """
        if writer is not None and self.store.state()["batches"].get(writer, -1) >= batch:
            return self.store.state()["version"]
        new = chunks.withColumn("scope_key", scope_key(*SCOPE))
        if not self.exists():
            return self.store.commit({**self._changes(new, None), **(also or {})}, writer, batch)
        new = cut(new, "new_chunks")
        docs = new.where("doc_id IS NOT NULL").select("scope_key", "doc_id")
        if removed is not None:
            docs = docs.unionByName(removed.where("doc_id IS NOT NULL").select(scope_key(*SCOPE).alias("scope_key"), "doc_id"))
        docs = cut(docs.distinct(), "docs")
        scopes = docs.select("scope_key").unionByName(new.select("scope_key")).distinct()
        held = self.live("chunks", scopes).select("scope_key", *PLACE, "text")
        after = held.where("doc_id IS NULL").groupBy("scope_key").agg((F.max("ordinal") + 1).alias("after"))
        moved = F.col("doc_id").isNull() & F.col("after").isNotNull()
        columns = new.columns
        new = new.join(after, "scope_key", "left").withColumn("ordinal", F.when(moved, F.col("ordinal") + F.col("after")).otherwise(F.col("ordinal")))
        new = cut(new.withColumn("chunk_id", F.when(moved, chunk_id()).otherwise(F.col("chunk_id"))).select(*columns), "placed_chunks")
        old = cut(held.join(docs, ["scope_key", "doc_id"], "left_semi"), "old_chunks")
        taken = None if "postings" in self._left() else self.live("postings", scopes).join(docs, ["scope_key", "doc_id"], "left_semi")
        return self.store.commit({**self._changes(new, (old, taken)), **(also or {})}, writer, batch)

    def _changes(self, new: DataFrame, old: tuple[DataFrame, DataFrame | None] | None) -> dict[str, Change]:
        """The new rows, and what they and the old ones (chunks, postings if there are any) do to the sums.

        All follows from the chunks that the version has written: postings where they are kept, and words are added up from them, else from the texts.
        """
        place, left, sums = ["scope_key", *SCOPE], self._left(), []
        gone = new.select("scope_key", "doc_id").limit(0) if old is None else old[0].select("scope_key", "doc_id").distinct()

        def words(fresh) -> DataFrame:
            """df and tf of words (place, term), of the old ones negative; still to be added up."""
            if "postings" not in left:
                counts = [(fresh("postings"), 1)] if old is None else [(fresh("postings"), 1), (old[1], -1)]
                return reduce(DataFrame.unionByName, (p.select(*place, "term", F.lit(n).alias("df"), (n * F.col("tf")).alias("tf")) for p, n in counts))
            if not sums:
                counts = [(fresh("chunks"), 1)] if old is None else [(fresh("chunks"), 1), (old[0], -1)]
                parts = [word_sums(c.select(*place, "text")).withColumns({"df": n * F.col("df"), "tf": n * F.col("tf")}) for c, n in counts]
                sums.append(cut(reduce(DataFrame.unionByName, parts), "word_sums"))
            return sums[0]

        def terms(fresh) -> DataFrame:
            return words(fresh).groupBy(*place, "term").agg(F.sum("df").alias("df")).where("df <> 0")

        def totals(fresh) -> DataFrame:
            length = words(fresh).groupBy(*place).agg(F.sum("tf").alias("length"))
            chunks = fresh("chunks").select(*place, F.lit(1).alias("sign"))
            chunks = chunks if old is None else chunks.unionByName(old[0].select(*place, F.lit(-1).alias("sign")))
            scopes = chunks.groupBy(*place).agg(F.sum("sign").alias("n"))
            same = reduce(lambda a, b: a & b, (scopes[c].eqNullSafe(length[c]) for c in place))
            both = scopes.join(length, same, "left").select(*(scopes[c] for c in place), "n", F.coalesce("length", F.lit(0)).alias("length"))
            return both.where("n <> 0 OR length <> 0")

        made = {name: new if name == "chunks" else (lambda fresh, name=name: self._rows(fresh("chunks"), name)) for name in OF_CHUNKS if name not in left}
        return {name: Change(rows, add=True, placed=name in PLACED) for name, rows in {**made, "terms": terms, "scopes": totals, "gone": gone}.items()}

    def compact(self, scopes: DataFrame | None = None) -> int:
        """Write the named scopes (scope_key; all, if none are named) as one version each; nothing of them is left to be looked up or added up."""
        wanted = (self.store.read("chunks") if scopes is None else scopes).select("scope_key").distinct()
        if scopes is None:
            wanted = wanted.unionByName(self.store.read("gone").select("scope_key")).distinct()
        wanted = cut(wanted, "scopes")
        changes = {name: Change(self.live(name, wanted), scopes=wanted) for name in OF_CHUNKS if name not in self._left()}
        changes |= {name: Change(self.sums(name, wanted), scopes=wanted) for name in SUMS}
        changes["gone"] = Change(self.store.read("gone").drop("version").limit(0), scopes=wanted)
        return self.store.commit(changes)


def build_index(chunks: DataFrame, root: str, **config) -> Index:
    """A new index of chunks in a folder."""
    index = Index(Versions(chunks.sparkSession, root), **config)
    index.upsert(chunks)
    return index
