"""The two audits and the removal of repeats, against SQL and brute-force versions on small tables."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from attesta.llm import divergence, filter_audit, run_index
from attesta.llm.queries import ORACLE_SQL

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_queries import rows  # noqa: E402

ODD = "doc_id long, text string, lang string, source string, n_chars int, part string, item string, d long, t string, h long, mask int, n long, term string"


def odd_docs(spark, docs):
    """docs (doc_id, text, lang, source) with extra columns of clashing names."""
    return spark.createDataFrame([(*d, 1, "p", "i", 2, "t", 3, 4, 5, "w") for d in docs], ODD)


def some_docs(seed, n=120):
    r = random.Random(seed)
    words = [*"aa Bb cc Straße ÉCOLE ee ff gg # hh $x Ii JJ kk LL mm 语言 nn a1b2".split(), "x y"]
    out = [(i * 7 % 113, " ".join(r.choices(words, k=r.choice([0, 3, 49, 50, 80]))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "S3", None, "", "ü"])) for i in range(n)]
    return [*out, (None, out[5][1], "en", "s1"), (None, None, None, None), (999, None, "en", "s9"), (999, None, "en", "s9"), (7, out[3][1], "xx", "lone"), *[(500 + i, out[7][1], "en", "s1") for i in range(60)]]


def by_sql(name, docs, labels=()):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    if docs:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", docs)
    if labels:
        con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    return rows(con.execute(ORACLE_SQL[name]).df())


def test_divergence_like_sql(spark):
    docs = some_docs(1)
    assert rows(divergence.divergence(odd_docs(spark, docs)).toPandas()) == by_sql("op11_divergence", docs)


def test_divergence_in_many_cells(spark, monkeypatch):
    """Small bands and blocks: the same rows."""
    docs = some_docs(2)
    want = rows(divergence.divergence(odd_docs(spark, docs), min_docs=2).toPandas())
    monkeypatch.setattr(divergence, "BAND", 3)
    assert rows(divergence.divergence(odd_docs(spark, docs), min_docs=2).toPandas()) == want


@pytest.mark.parametrize(("groups", "terms", "filled"), [(1, 1, 0.5), (7, 40, 0.1), (30, 5, 0.6), (20, 300, 0.02)])
def test_tree_prices_all_pairs(groups, terms, filled):
    r = np.random.default_rng(groups)
    dense = np.where(r.random((groups, terms)) < filled, r.integers(1, 1000, (groups, terms)), 0)
    unseen = r.integers(1, 9, groups)
    row, col = np.nonzero(dense)
    tree = divergence.SquareTree(row, divergence.by_holders(row, col, terms)[col], dense[row, col], terms)
    i, j = np.triu_indices(groups, 1)
    shares = np.where(dense > 0, dense, unseen[:, None])
    assert (divergence.pair_sums(tree, i, j, unseen) == np.abs(shares[i] - shares[j]).sum(1)).all()


def test_divergence_of_little(spark):
    """No kept term: pairs of value 0; one source: no pairs; no rows: none."""
    docs = [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "c", "de", "x")]
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(odd_docs(spark, docs)).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert divergence.divergence(odd_docs(spark, [])).count() == 0


def test_divergence_counts_long_texts_in_pieces(spark, monkeypatch):
    docs = [(i, "wörter Und words " * 40, "en", f"s{i % 2}") for i in range(31)]
    want = rows(divergence.divergence(odd_docs(spark, docs)).toPandas())
    assert want == by_sql("op11_divergence", docs)
    from attesta.llm._common import pieces

    data = ("wörter Und words " * 40).encode()
    assert b"".join(pieces(data, divergence.BREAK, 7)) == data
    assert [w for p in pieces(data, divergence.BREAK, 7) for w in p.split()] == data.split()


def interactions(docs, labels):
    """Every document through every order, one by one."""
    least = {}
    for d, t, _, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    out, shapley = defaultdict(Counter), Counter()
    for d, t, _, source in docs:
        t, part = t or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t]]
        for order in permutations("ABCDE"):
            gone = False
            for k, x in enumerate(order):
                c, fail = out[part, "".join(order), k + 1], fails["ABCDE".index(x)]
                c["redundant"] += fail and gone
                c["unique_fails"] += fail and sum(fails) == 1
                if fail and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good_lost"] += d in good
                    c["toxic_lost"] += d in toxic
                    shapley[part, x] += 1
                c["kept"] += not gone
    return {(*k, *(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_filters_like_brute_force_and_sql(spark):
    docs = some_docs(3)
    labels = [(i, i % 2, i % 3) for i in range(100)] + [(4, None, None), (5, 0, 1), (5, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame([(*x, "part") for x in labels], "doc_id long, quality int, toxic int, mask string")
    got = filter_audit.filter_interactions(odd_docs(spark, docs), table).toPandas()
    assert set(got.itertuples(index=False, name=None)) == interactions(docs, labels)
    assert len(got) == 600 * len({s or "" for _, _, _, s in docs})
    assert rows(got) == by_sql("op12_filters", docs, labels)


def test_filters_of_no_rows(spark):
    assert filter_audit.filter_interactions(odd_docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_packed_fields_hold_very_large_counts():
    n = (1 << 62) + 5
    got = filter_audit.unpacked("p", n * filter_audit.packed(0b00011 + 32)).to_pandas()
    first = got[(got.filter_order == "BACDE")].sort_values("step")
    assert first["removed"].tolist() == [n, 0, 0, 0, 0] and first["redundant"].tolist() == [0, n, 0, 0, 0] and first["good_lost"].tolist() == [n, 0, 0, 0, 0] and first["kept"].tolist() == [0] * 5


def without_repeats(docs, length):
    last = (1 << 63) - 1
    texts = [(last if d is None else d, (t or "").encode()) for d, t, _, _ in docs]
    first = {}
    for d, x in texts:
        for i in range(len(x) - length + 1):
            first[x[i : i + length]] = min((d, i), first.get(x[i : i + length], (d, i)))
    out = []
    for (name, _, _, _), (d, x) in zip(docs, texts):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if (d, i) > first[x[i : i + length]]:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out.append((name, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeating(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abc é") for _ in range(r.randint(90, 400))) for _ in range(12)]
    new = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 120)))
    out = [(i * 3 % 101 if r.random() < 0.9 else None, "".join(r.choice([new(), r.choice(passages), r.choice(passages)[r.randint(0, 50) :]]) for _ in range(r.randint(0, 6)))) for i in range(120)]
    out += [(5, None), (7, "x" * 1000), (8, "x" * 500 + "y" + "x" * 300), (9, "ab" * 400), (10, "y" * 99), (11, "z" * 100), (2000, out[3][1]), (2000, out[3][1]), (2001, out[4][1]), (-3, out[4][1]), (None, out[5][1]), (None, out[5][1])]
    return [(d, t, "en", "s") for d, t in out]


@pytest.mark.parametrize("how", [{}, {"crowd": 2}, {"bucket_bytes": 2000}])
def test_repeats_like_brute_force(spark, how):
    docs = repeating(len(how) + how.get("crowd", 0))
    got = run_index.remove_repeats(odd_docs(spark, docs), **how).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(docs, 100)


def test_repeats_of_another_length(spark):
    docs = repeating(9)[:40]
    got = run_index.remove_repeats(odd_docs(spark, docs), length=16, gram=8).collect()
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(docs, 16)


def test_repeats_in_parts_of_batches(spark):
    """Rows of one anchor that go over batches are judged as in one."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        docs = repeating(4)[:50]
        got = run_index.remove_repeats(odd_docs(spark, docs)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((tuple(r) for r in got), key=str) == without_repeats(docs, 100)


def test_repeats_of_no_rows(spark):
    assert run_index.remove_repeats(odd_docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    """Each position's predecessor in suffix order, and their agreement, follow from the samples."""
    r = random.Random(seed)
    base = bytes(r.choices(b"abc", k=60))
    strings = [base[r.randint(0, 20) : r.randint(25, 60)] + bytes(r.choices(b"ab\0", k=r.randint(1, 9))) for _ in range(12)]
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    bounds = np.cumsum([len(s) for s in strings])
    ends = np.repeat(bounds, [len(s) for s in strings])
    index = run_index.RunIndex(data, ends)
    suffix = lambda i: bytes(data[i : ends[i]])
    order = sorted(range(len(data)), key=lambda i: (suffix(i), i))
    above = {b: a for a, b in zip(order, order[1:])}
    source, size = index.matching_statistics(0, len(data))
    for i in range(len(data)):
        j = above.get(i, -1)
        agreed = 0
        while j >= 0 and suffix(i)[agreed : agreed + 1] and suffix(i)[agreed : agreed + 1] == suffix(j)[agreed : agreed + 1]:
            agreed += 1
        assert (source[i], size[i]) == (j, agreed)
    assert index.run.sum() == len(data) and len(index.sample) < len(data)
