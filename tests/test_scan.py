"""Lanes made in one pass over the texts, against those made by joins."""

import random
import re

import pyarrow as pa
import pytest

from attesta.functions.words import words_of
from attesta.operators import chunks as C
from attesta.operators import graph as G
from attesta.operators import lanes as L
from attesta.operators import scan
from attesta.operators.index import build_index

LATER = ("postings", "weights", "concepts")


def chunked(spark, *docs):
    pages = spark.createDataFrame([(i, t, "m", f"{i}.txt", None, text) for i, t, text in docs], "doc_id long, tenant_id string, matter_id string, filename string, page int, text string")
    return C.chunk_pages(pages, 60, 10)


def corpus(spark, seed, n=30):
    """Documents of a few chunks with shared concepts, equal texts and texts without a word; questions without, with common and with unknown words."""
    r = random.Random(seed)
    part = lambda: " ".join([*(f"Section {r.randint(1, 5)}" for _ in range(r.choice([0, 0, 1, 2]))), *(r.choice(["alpha", "Beta", "gamma_1", "the", "é é"]) for _ in range(r.randint(1, 9)))])
    docs = [(i, "t" if i % 4 else "u", ". ".join(part() for _ in range(r.randint(1, 4)))) for i in range(n)]
    docs += [(n + i, "t", text) for i, text in enumerate(["alpha", "alpha", "é ü", "the the the"])] + [(n + 9, None, "alpha Section 1")]
    asked = [(0, "t", "m", "alpha"), (1, "t", "m", "Beta gamma_1 nowhere beta"), (2, "t", "m", "é"), (3, "t", "m", "section the"), (4, "u", "m", "the alpha"), (5, "v", "m", "alpha"), (6, None, "m", "alpha"), (7, "u", "m", "nowhere")]
    return chunked(spark, *docs), spark.createDataFrame(asked, "question_id long, tenant_id string, matter_id string, question string")


def shown(lane):
    return sorted((r.question_id, r["rank"], r.tenant_id, r.chunk_id, r.doc_id, r.ordinal, f"{r.score:.8f}") for r in lane.collect())


@pytest.mark.parametrize(("cells", "block", "task_rows", "k"), [(scan.CELLS, scan.BLOCK, G.TASK_ROWS, 50), (2000, 2, 0, 4), (1, 1, 60, 4)])
def test_one_pass_finds_what_the_joins_find(spark, tmp_path, monkeypatch, cells, block, task_rows, k):
    """All in one go, in small parts, and scopes too large for a task beside small ones. No table of words is written for it."""
    monkeypatch.setattr(G.scanned_top, "__defaults__", (*G.scanned_top.__defaults__[:-1], task_rows))
    monkeypatch.setattr(scan.scanned, "__defaults__", (block, cells))
    chunks, asked = corpus(spark, 3)
    index = build_index(chunks, f"{tmp_path}/a", dim=16, mode="md5", later=LATER)
    got = [shown(lane) for lane in L.search_lanes(asked, index, k)]
    assert not set(LATER) & set(index.store.state()["schemas"])
    assert got == [shown(lane) for lane in L.search_lanes(asked, index, k, limit=0)] and all(len(lane) > 15 for lane in got)
    assert [lane.count() for lane in L.search_lanes(asked.limit(0), index)] == [0, 0, 0]


def test_retrieve_writes_no_words(spark, tmp_path):
    chunks, asked = corpus(spark, 4)
    index = build_index(chunks, f"{tmp_path}/a", later=LATER)
    hits = lambda df: sorted((r.question_id, r["rank"], r.chunk_id, round(r.rerank_score, 8)) for r in df.collect())
    got = hits(L.retrieve(asked, None, index=index))
    assert set(index.store.state()["schemas"]) == {"chunks", "terms", "scopes", "gone"}
    assert got == hits(L.retrieve(asked, index.chunks().cache())) and len(got) > 20


def test_words_by_bytes_are_those_of_the_pattern():
    r = random.Random(1)
    texts = ["".join(r.choice("aZ09_ .é中ß\n-Kİ") for _ in range(r.randint(0, 12))) for _ in range(2000)] + [None, "", "a", "b"]
    for t in (pa.array(texts), pa.array(texts).slice(5, 900), pa.array([], pa.string()), pa.array(["", None])):
        of, words = words_of(t)
        assert list(zip(of.tolist(), words.to_pylist())) == [(i, w.lower()) for i, s in enumerate(t.to_pylist()) for w in re.findall("[A-Za-z0-9_]+", s or "")]


def test_sums_without_postings(spark, tmp_path):
    """Frequencies come from the texts as long as no postings are kept, through upserts and removals, and are those of an index with them."""
    docs = {i: (i, "t" if i % 3 else None, f"common word{i % 3} word{i % 3} section {i % 2}") for i in range(9)}
    index = build_index(chunked(spark, *docs.values()), f"{tmp_path}/a", later=LATER)
    new = [(3, None, "common other"), (4, "t", "quite new"), (20, "w", "more")]
    gone = spark.createDataFrame([(5, "t", "m"), (6, None, "m")], "doc_id long, tenant_id string, matter_id string")
    index.upsert(chunked(spark, *new), removed=gone)
    assert "postings" not in index.store.state()["schemas"]
    want = build_index(chunked(spark, *(d for i, d in docs.items() if i not in (3, 4, 5, 6)), *new), f"{tmp_path}/b")
    shown = lambda i: [sorted(map(str, i.sums(n).drop("scope_key").collect())) for n in ("terms", "scopes")] + [sorted(map(str, i.postings()[0].select("tenant_id", "term", "chunk_id", "doc_id", "tf", "dl").collect()))]
    assert shown(index) == shown(want)
    for i in (index, want):  # both keep postings now
        i.upsert(chunked(spark, (4, "t", "new again")))
    assert shown(index) == shown(want)


def test_a_text_is_cleaned_once(spark):
    """The filter of empty texts does not clean them anew."""
    pages = spark.createDataFrame([(1, "t", "m", "f", None, " a  b " * 40), (2, "t", "m", "f", None, " \n "), (3, "t", "m", "f", None, None)], "doc_id long, tenant_id string, matter_id string, filename string, page int, text string")
    cut = C.chunk_pages(pages.repartition(2), 60, 10)
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    whole = ("a b " * 40).strip()
    assert [r.text for r in cut.orderBy("ordinal").collect()] == [whole[i : i + 60].strip() for i in range(0, 150, 50)]


@pytest.mark.parametrize("name", ["r60_candidates", "r61_rerank_scores", "r95_graph_lift", "r98_answer_stream"])
def test_queries_of_all_lanes_write_no_words(spark, tmp_path, name):
    """The rows of the SQL, and nothing of single words beside the sums in the index that the query builds."""
    from attesta.plans.retrieval import standing
    from test_queries import AT, same, written

    docs = [{"doc_id": i, "text": f"{t} License terms, version {i % 3}.", "lang": "en", "source": f"src{i % 2}", "n_chars": 0} for i, t in enumerate(["the Alpha one.", "Beta of it.", "alpha and beta both.", "", "gamma, the last."] * 3)]
    con = written(AT, tmp_path, documents=docs, benchmark={"item_id": [0, 1, 20], "text": ["alpha of the license", "beta version 1", "gamma"]})
    assert same(spark, con, name, tmp_path)
    assert set(standing(spark, str(tmp_path)).store.state()["schemas"]) == {"chunks", "terms", "scopes", "gone"}
