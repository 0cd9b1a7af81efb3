"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

AT = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())
ONE_ROW = {"r96_gate_check"}  # one row of metrics meets one row of thresholds


def rows(df):
    df = df[sorted(df.columns)].astype(object)

    def show(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return str([show(x) for x in v])
        if v is None or pd.isna(v):
            return "null"
        return f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return list(df.columns), sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{AT}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, AT)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in ONE_ROW or "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert rows(df.toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_approximate_search_finds_nearly_all(spark):
    from attesta.plans import retrieval as R

    at = "/root/testdata/sf0.1"
    exact = {(r.question_id, r.chunk_id) for r in R.dense_top_k(spark, at).where("rank <= 20").collect()}
    found = {(r.question_id, r.chunk_id) for r in R.dense_top_k_approx(spark, at).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def written(at, tmp_path, **tables):
    """The smallest tables, some of them others."""
    for f in os.listdir(at):
        if f.split(".")[0] not in tables:
            os.symlink(f"{at}/{f}", tmp_path / f)
    con = duckdb.connect()
    for name, rows_ in tables.items():
        pd.DataFrame(rows_).to_parquet(tmp_path / f"{name}.parquet", index=False)
    for f in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tmp_path}/{f}'")
    return con


def same(spark, con, name, at):
    return rows(entry.queries()[name](spark, str(at)).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["r62_definition_boost", "r70_definition_answers", "r73_definition_fallback", "r75_answers_type"])
def test_passages_without_a_long_word_or_with_definitions_of_their_own(spark, tmp_path, name):
    texts = ["on er to.", "Thin er on.", "on thin er.", "So the ndattion is onor blely by. Er.", "The rethble is in it.", "Er, thstortion is the one."]
    assert same(spark, written(AT, tmp_path, benchmark={"item_id": range(6), "text": texts}), name, tmp_path)


@pytest.mark.parametrize("name", ["r61_rerank_scores", "r66_retrieve", "r80_answer_questions", "r98_answer_stream"])
def test_passages_that_ask_for_a_definition(spark, tmp_path, name):
    docs = [{"doc_id": i, "text": t, "lang": "en", "source": "src1", "n_chars": len(t)} for i, t in enumerate(["Er on and of the.", "Sallow er what known as on it, in from er the and of to. Here on is as from.", "What on er the, sallow as it. More on it."])]
    con = written(AT, tmp_path, documents=docs, benchmark={"item_id": [1], "text": ["Er on sallow what the from it."]})
    assert same(spark, con, name, tmp_path)


def test_weights_at_a_half(spark, tmp_path):
    """Weights of 41, 323 and 333 times 1/640 lie at a half of the sixth digit."""
    from attesta.plans.retrieval import digits

    x = [k / 640 for k in (41, 323, 333, 1, 7)]
    got = [r.w for r in spark.createDataFrame([(v,) for v in x], "x double").select(digits("x").alias("w")).collect()]
    assert got == [r[0] for r in duckdb.sql(f"SELECT round(unnest({x}::DOUBLE[]), 6)").fetchall()]


def test_words_that_cancel_out(spark, tmp_path):
    """Two words of one place and opposite signs: 0 / 0 in the SQL, which is a row."""
    from hashlib import md5

    from attesta.plans.retrieval import DIM

    seen: dict = {}
    for w in (f"w{i}" for i in range(10_000)):
        h = md5(w.encode()).hexdigest()
        place, sign = int(h[:8], 16) % DIM, int(h[8:10], 16) % 2
        if (place, 1 - sign) in seen:
            break
        seen[place, sign] = w
    text = f"{w} {seen[place, 1 - sign]}"
    con = written(AT, tmp_path, documents=[{"doc_id": i, "text": t, "lang": "en", "source": "src1", "n_chars": len(t)} for i, t in enumerate([text, text + " more", ""])])
    got = entry.queries()["r46_hash_embed"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(con.execute(entry.oracle_sql()["r46_hash_embed"]).df()) and got.weight.isna().sum() == 1


def test_codes_rule_out_no_neighbour(spark):
    """Vectors without clusters, with copies: the bounded search gives the rows of the exact one."""
    import numpy as np

    from attesta.operators import lanes as L

    x = np.random.default_rng(5).normal(size=(1500, 32))
    x[700:750] = x[100]
    c = spark.createDataFrame([(f"c{i}", "t", "m", i, 0, v.tolist()) for i, v in enumerate(x)], "chunk_id string, tenant_id string, matter_id string, doc_id long, ordinal int, embedding array<double>")
    q = spark.createDataFrame([(i, "t", "m", x[i].tolist()) for i in range(0, 1500, 50)], "question_id long, tenant_id string, matter_id string, q_vector array<double>")
    found = lambda df: sorted((r.question_id, r.rank, r.chunk_id) for r in df.collect())
    assert found(L.dense_top_k_approx(q, c, 20, exact=True)) == found(L.dense_top_k(q, c, 20)) != found(L.dense_top_k_approx(q, c, 20, rerank=1))
    assert L.dense_top_k_approx(q, c.limit(0), 20, exact=True).isEmpty()
