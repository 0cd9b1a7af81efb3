"""Tables that change version by version, and the index that lives on them."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import chunks as C
from attesta.operators import lanes as L
from attesta.operators.index import Index, build_index
from attesta.sources import scratch
from attesta.sources import versions as V

ROW = "doc_id long, tenant_id string, matter_id string, rev int"


def keyed(spark, *rows):
    return spark.createDataFrame(rows, ROW).withColumn("scope_key", V.scope_key("tenant_id", "matter_id"))


def rows(df):
    return sorted(map(str, df.select("doc_id", "tenant_id", "matter_id", "rev").collect()))


def test_upsert_touches_its_scopes_only(spark, tmp_path):
    table = V.Versions(spark, str(tmp_path))
    first = [(1, "a", "x", 1), (2, "a", "x", 1), (3, "b", None, 1), (4, None, "y", 1)]
    V.upsert_rows(table, "docs", keyed(spark, *first, (1, "a", "x", 0)), ["scope_key", "doc_id"], "rev")
    assert rows(table.read("docs")) == rows(keyed(spark, *first))
    V.upsert_rows(table, "docs", keyed(spark, (2, "a", "x", 2), (5, "a", "x", 1), (1, "a", "x", 0), (4, None, "y", 3)), ["scope_key", "doc_id"], "rev")
    want = [(1, "a", "x", 1), (2, "a", "x", 2), (3, "b", None, 1), (4, None, "y", 3), (5, "a", "x", 1)]
    assert rows(table.read("docs")) == rows(keyed(spark, *want)) and rows(table.read("docs", 1)) == rows(keyed(spark, *first))
    assert {r.version for r in table.read("docs").where("tenant_id = 'b'").collect()} == {1}
    assert len(table.vacuum()) == 1 and rows(table.read("docs")) == rows(keyed(spark, *want))
    # version 3 takes the place of all that version 1 still held
    table.commit({"docs": V.Change(keyed(spark, (3, "b", None, 9)))})
    assert [p.rpartition("/")[2] for p in table.vacuum()] == ["version=1", "2"] and {r.rev for r in table.read("docs").where("tenant_id = 'b'").collect()} == {9}


@pytest.mark.parametrize("where", ["_written", "_publish"])
def test_a_failure_amid_the_write_leaves_the_old_table(spark, tmp_path, monkeypatch, where):
    table = V.Versions(spark, str(tmp_path))
    table.commit({"docs": V.Change(keyed(spark, (1, "a", "x", 1))), "more": V.Change(keyed(spark, (8, "a", "x", 1)))})

    def fails(*_):
        raise OSError("stopped")

    monkeypatch.setattr(V.Versions, where, fails)
    with pytest.raises(OSError):
        table.commit({"docs": V.Change(keyed(spark, (1, "a", "x", 2), (2, "c", "z", 2)))})
    assert rows(table.read("docs")) == rows(keyed(spark, (1, "a", "x", 1)))
    monkeypatch.undo()
    table.commit({"docs": V.Change(keyed(spark, (7, "d", "x", 3)))})  # the next writer takes the number of the one that failed
    assert rows(table.read("docs")) == rows(keyed(spark, (1, "a", "x", 1), (7, "d", "x", 3))) and table.read("more").count() == 1


def test_a_batch_counts_once(spark, tmp_path):
    table = V.Versions(spark, str(tmp_path))
    one = {"docs": V.Change(keyed(spark, (1, "a", "x", 1)), add=True)}
    assert [table.commit(one, "w", 0), table.commit(one, "w", 0), table.commit(one, "w", 1), table.commit(one, "v", 0)] == [1, 1, 2, 3]
    assert table.read("docs").count() == 3


def chunked(spark, *docs):
    pages = spark.createDataFrame([(i, t, "m", f"{i}.txt", None, text) for i, t, text in docs], "doc_id long, tenant_id string, matter_id string, filename string, page int, text string")
    return C.chunk_pages(pages, 60, 10)


def state(index):
    """All that the index holds, with rounded numbers."""
    tables = [index.chunks(), index.weights(), index.concepts(), *index.postings()]
    shown = lambda df: df.select(*((F.round(c, 9) if t == "double" else F.col(c)).alias(c) for c, t in sorted(df.dtypes)))
    return [sorted(map(str, shown(df).collect())) for df in tables]


def test_upserts_equal_a_full_build(spark, tmp_path):
    text = lambda i: f"section {i % 3} word{i % 7} common term{i % 5} " * (1 + i % 4)
    docs = {(i, "t" if i % 3 else None): text(i) for i in range(20)}
    index = build_index(chunked(spark, *((*k, v) for k, v in docs.items())), f"{tmp_path}/a")
    new = {(3, None): "quite new words, section 9", (4, "t"): "common again", (30, "t"): text(30), (31, "u"): "another scope"}
    index.upsert(chunked(spark, *((*k, v) for k, v in new.items())))
    gone = spark.createDataFrame([(5, "t", "m"), (6, None, "m"), (77, "t", "m")], "doc_id long, tenant_id string, matter_id string")
    index.upsert(chunked(spark, (1, "t", "once more")), removed=gone)
    docs = {k: v for k, v in {**docs, **new, (1, "t"): "once more"}.items() if k not in {(5, "t"), (6, None)}}
    want = build_index(chunked(spark, *((*k, v) for k, v in docs.items())), f"{tmp_path}/b")
    assert state(index) == state(want)
    plain = L.build_postings(want.chunks())
    assert [sorted(map(str, a.select(sorted(a.columns)).drop("idf", "avgdl").collect())) for a in index.postings()] == [sorted(map(str, b.select(sorted(a.columns)).drop("idf", "avgdl").collect())) for a, b in zip(index.postings(), plain)]
    before = index.store.state()["version"]
    index.compact()
    assert state(index) == state(want) and not index._any_gone() and index.store.state()["version"] == before + 1
    assert len(index.store.vacuum()) > 0 and state(index) == state(want)


def test_an_upsert_writes_its_own_terms_only(spark, tmp_path):
    index = build_index(chunked(spark, *((i, "t", f"common word{i}") for i in range(50))), f"{tmp_path}/a")
    version = index.upsert(chunked(spark, (7, "t", "common other")))
    delta = {(r.term, r.df) for r in index.store.read("terms").where(F.col("version") == version).collect()}
    assert delta == {("word7", -1), ("other", 1)}  # "common" went and came
    assert index.store.read("postings").where(F.col("version") == version).count() == 2


def test_documents_without_an_id_are_added(spark, tmp_path):
    index = build_index(chunked(spark, (None, "t", "first")), f"{tmp_path}/a")
    index.upsert(chunked(spark, (None, "t", "second")))
    got = index.chunks().orderBy("ordinal").collect()
    assert [(r.ordinal, r.text) for r in got] == [(0, "first"), (1, "second")] and got[0].chunk_id != got[1].chunk_id


def test_search_over_a_standing_index(spark, tmp_path):
    """The same hits as over chunks, and as many as each question asks for."""
    index = build_index(chunked(spark, *((i, "t", f"alpha beta word{i % 4} section {i % 3}. Sentence {i} of it.") for i in range(15))), f"{tmp_path}/a")
    index.upsert(chunked(spark, (2, "t", "alpha alpha section 1")))
    ask = spark.createDataFrame([(k, "t", "m", q, n) for k, (q, n) in enumerate([("alpha word1", 1), ("what is section 1", 3), ("beta", 8), ("word3", 12)])], "question_id long, tenant_id string, matter_id string, question string, top_k int")
    shown = lambda df: sorted((r.question_id, r["rank"], r.chunk_id, round(r.rerank_score, 9)) for r in df.collect())
    got = shown(L.retrieve(ask, None, index=index))
    assert got == shown(L.retrieve(ask, scratch.cut(index.chunks())))
    assert [sum(q == k for q, *_ in got) for k in range(4)] == [1, 3, 8, 12]
    first = shown(L.retrieve(ask.drop("top_k"), None, index=index))
    assert [sum(q == k for q, *_ in first) for k in range(4)] == [8, 8, 8, 8]


def test_nothing_is_indexed(spark, tmp_path):
    index = Index(V.Versions(spark, f"{tmp_path}/a"))
    assert not index.exists()
    index.upsert(chunked(spark, (1, "t", " ")))
    assert index.exists() and index.chunks().count() == 0 and [t.count() for t in index.postings()] == [0, 0, 0]


def test_words_are_counted_where_their_text_is(spark):
    """Terms and weights are those of grouped words, without an exchange; few asked rows do not move the postings."""
    from attesta.functions.text import tokenize
    from attesta.sources.scratch import few

    t = spark.createDataFrame([(1, "a b A é b_1"), (2, ""), (3, None), (4, "c " * 500), (5, "x y z x")], "id long, text string")
    shown = lambda df: sorted(map(str, df.collect()))
    words = t.select("id", F.size(tokenize("text")).cast("long").alias("dl"), F.explode(tokenize("text")).alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    assert shown(L.words_in_rows(t)) == shown(words)
    for mode in ("md5", "blake2b"):
        assert shown(L.words_in_rows(t, 384, mode)) == shown(L.hash_weights(t, 384, mode))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(L.words_in_rows(t, 384))
    assert "BroadcastHashJoin" in plan(few(t.select("id")).join(t, "id"))


def test_words_are_not_counted_again_for_their_frequencies(spark, tmp_path, monkeypatch):
    """Document frequencies come from the postings that are written; sums of one version are not added up when they are read."""
    from attesta.operators import index as module

    asked = []
    monkeypatch.setattr(module, "words_in_rows", lambda *a: asked.append(a) or L.words_in_rows(*a))
    index = build_index(chunked(spark, *((i, "t", f"common word{i % 3}") for i in range(9))), f"{tmp_path}/a")
    assert len(asked) == 2  # postings and weights
    plan = index.sums("terms")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and sorted((r.term, r.df) for r in index.sums("terms").collect()) == [("common", 9), ("word0", 3), ("word1", 3), ("word2", 3)]
    index.upsert(chunked(spark, (3, "t", "common other")))
    assert sorted((r.term, r.df) for r in index.sums("terms").collect()) == [("common", 9), ("other", 1), ("word0", 2), ("word1", 3), ("word2", 3)]
    assert {(r.n, r.length) for r in index.sums("scopes").collect()} == {(9, 18)}


def test_postings_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """The files of the few scopes of a partition are written side by side, so that no task sorts all its words."""
    from pyspark.sql.readwriter import DataFrameWriter

    write, writers = DataFrameWriter.parquet, {}
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (writers.update({path.split("/")[-2]: spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")}), write(self, path, *a, **k))[1])
    index = build_index(chunked(spark, *((i, f"t{i % 5}", f"common word{i}") for i in range(20))), f"{tmp_path}/a")
    assert (writers["postings"], writers["weights"], writers["chunks"]) == ("16", "16", "0")
    found = index.store.read("postings").groupBy("tenant_id").count().collect()
    assert sorted((r.tenant_id, r["count"]) for r in found) == [(f"t{i}", 8) for i in range(5)]


def test_a_table_made_from_what_the_version_wrote(spark, tmp_path):
    table = V.Versions(spark, str(tmp_path))
    for at in (1, 2):
        more = V.Change(lambda fresh: fresh("docs").groupBy("scope_key", "tenant_id").agg(F.count("*").alias("n")), add=True)
        table.commit({"docs": V.Change(keyed(spark, *((i, "a", "x", 1) for i in range(at))), add=True), "more": more})
    assert sorted((r.tenant_id, r.n, r.version) for r in table.read("more").collect()) == [("a", 1, 1), ("a", 2, 2)]


def test_a_given_sparse_lane_is_not_searched_again(spark, tmp_path, monkeypatch):
    index = build_index(chunked(spark, *((i, "t", f"alpha beta word{i % 4} section {i % 3}.") for i in range(15))), f"{tmp_path}/a")
    ask = spark.createDataFrame([(1, "t", "m", "alpha word1"), (2, "t", "m", "what is section 1")], "question_id long, tenant_id string, matter_id string, question string")
    shown = lambda df: sorted((r.question_id, r["rank"], r.chunk_id, round(r.rerank_score, 9)) for r in df.collect())
    want, lane = shown(L.retrieve(ask, None, index=index)), scratch.cut(L.bm25_top_k(ask, index.chunks(), index=index.postings()))
    monkeypatch.setattr(L, "bm25_top_k", None)
    assert shown(L.retrieve(ask, None, index=index, sparse=lane)) == want


def test_rerank_score_makes_its_words_once(spark):
    """A question's and a text's words are taken apart once each, not anew for every word of the text."""
    df = spark.createDataFrame([("what is a graph", "Graphs are a graph of nodes", 0.5), ("the", "x", 0.25), ("graph", "", 0.25)], "question string, text string, score double")
    for definitions in (True, False):
        scored = df.select(L.rerank_score(definitions=definitions).alias("s"))
        assert scored._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert [round(r.s, 9) for r in scored.collect()] == [round(0.75 + 0.25 / 6 * 1 + 0.025, 9), 0.25, 0.0]


def test_weights_and_concepts_are_made_when_they_are_read(spark, tmp_path):
    """A search by BM25 needs neither; made later, after an upsert, they are those of an index that had them from the start."""
    docs = [(i, "t" if i % 3 else "u", f"common word{i % 3} section {i % 2}") for i in range(9)]
    index = build_index(chunked(spark, *docs), f"{tmp_path}/a", later=("weights", "concepts"))
    assert not {"weights", "concepts"} & set(index.store.state()["schemas"])
    index.upsert(chunked(spark, (3, "u", "common other section 5")))
    want = build_index(chunked(spark, *(d for d in docs if d[0] != 3), (3, "u", "common other section 5")), f"{tmp_path}/b")
    assert state(index) == state(want) and {"weights", "concepts"} <= set(index.store.state()["schemas"])
    for i in (index, want):
        i.upsert(chunked(spark, (4, "t", "quite new section 7")))
    assert state(index) == state(want)
