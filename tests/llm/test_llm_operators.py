"""Each operator against a brute-force version, and on odd rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import re
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from attesta.llm import exact_topk, html_text, licenses, nearest, packing, quality, secrets, simhash, toxicity, word_bpe
from attesta.llm.queries import ORACLE_SQL, tokenizer_path

ODD = [
    "", None, " \n\t ", "a", "x " * 40_000, "z" * 60_000, "same text of a few words", "same text of a few words", "Ünïcödé 日本語 😀 ǅ Σ", "<|endoftext|> in a text <|startoftext|>",
    "token = \"abcdefgh12\" cc by MIT License", "you idiot you moron you are pathetic scum", "password=secret:abcdefgh1", "user_name: bob https://x.y/z AbCdEfGhIjKlMnOpQrStUvWx12",
]
CLASH = ["score", "predicted", "held_out", "label", "raw", "features", "fp", "cell", "salt", "length", "start", "base", "weak", "extra", "part_key", "row", "row_key", "pos", "rank", "at"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else 6, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 % 2, int(i in (11, 3))) for i in range(14)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_scores_of_odd_rows(spark, docs, labels, scores):
    got = scores(docs, labels).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == docs.count()
    assert got.score.between(0, 1).all() and not got.held_out[got.doc_id.isna()].any()
    held = got.dropna(subset=["doc_id"])
    assert (held.held_out == [crc32(str(int(i)).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert len(scores(docs.limit(0), labels).collect()) == 0
    assert scores(docs, labels.limit(0)).toPandas().score.eq(0).all()


@pytest.mark.parametrize("name,scores", [("toxic", toxicity.toxicity_scores), ("quality", quality.quality_scores)])
def test_held_out_accuracy(spark, name, scores):
    at = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", F.col(name).alias("truth"))
    got = scores(spark.read.parquet(f"{at}/documents.parquet"), truth.withColumnRenamed("truth", name)).join(truth, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.truth).mean() > 0.96
    ranks, ones = got.score.rank(), got.truth == 1
    assert (ranks[ones].mean() - (ones.sum() + 1) / 2) / (~ones).sum() > 0.95
    if name == "toxic":  # calibrated: scores are shares of label 1
        assert abs(got.score.mean() - got.truth.mean()) < 0.03 and got.truth[got.score < 0.2].mean() < 0.1 and got.truth[got.score > 0.8].mean() > 0.9


def test_toxicity_features():
    text, log = "You IDIOT! you id1ot, fine.", np.log1p
    got = dict(zip(toxicity.FEATURES, toxicity.features_of(text, frozenset({"fine"}), frozenset({"idiot"}))))
    want = {
        "seed": 1 / 6, "terms": 1 / 6, "prefixes": 1 / 6, "hits": log(2), "any": 1, "near_you": 2 / 6, "you": 2 / 6, "caps": 6 / 19, "exclaim": 1 / 27, "punct": 3 / 27, "masked": 1 / 6,
        "masked_hits": 0, "digits": 1 / 27, "length": log(27),
    }
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    long = "m0r" + "o" * 60 + "n"
    assert toxicity.features_of(long, frozenset(), frozenset())[toxicity.FEATURES.index("masked")] > 0


def test_a_repeated_id_trains_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, toxic int")
    from attesta.llm._common import labelled_sample

    got = sorted((r.doc_id, r.label, r.text) for r in labelled_sample(docs, labels, "toxic", 100).collect())
    assert got == [(i, x, t) for i, x, t in ((1, 1, "text 0"), (2, 0, "b"), (3, 1, None)) if crc32(str(i).encode()) % 5]
    assert labelled_sample(docs, labels, "toxic", 1).count() <= 1


def test_quality_trains_on_inputs_that_count(spark, monkeypatch):
    """The machine's vectors are as long as the inputs that count, each of which some row holds: what a round sends and adds up is no longer."""
    seen = []

    class Watched(quality.FMClassifier):
        def fit(self, df):
            rows = [r.features for r in df.collect()]
            seen.append(({v.size for v in rows}, {int(i) for v in rows for i in v.indices}))
            return super().fit(df)

    monkeypatch.setattr(quality, "FMClassifier", Watched)
    at = "/root/testdata/sf0.001"
    quality.quality_scores(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"), rounds=2).count()
    (sizes, used), = seen
    assert sizes == {len(used)} and used == set(range(len(used))) and len(used) < quality.SIZE


def test_quality_inputs():
    at, values = quality.inputs_of("b a a\n", None, {})
    slots = {crc32(w.encode()) % quality.HASHED: c for w, c in (("a", np.log1p(2)), ("b", np.log1p(1)))}
    norm = sum(v * v for v in slots.values()) ** 0.5
    assert at[:2] == sorted(slots) and np.allclose(values[:2], [slots[k] / norm for k in sorted(slots)])
    assert values[2:] == [1.0] * len(quality.CUTS) and len(at) == len(values)
    stats = dict(zip(quality.CUTS, ((i - quality.HASHED) % quality.STEPS for i in at[2:])))
    assert (stats["log_chars"], stats["distinct"], stats["repeats"], stats["word_chars"], stats["line_words"]) == (0, 6, 5, 0, 1)
    assert [(i - quality.HASHED) // quality.STEPS for i in at[2:]] == list(range(len(quality.CUTS)))


def test_fm_identity():
    rng = np.random.default_rng(1)
    v, w, x = rng.normal(size=(6, 3)), rng.normal(size=6), [0.5, 2.0, -1.0]
    at = [0, 3, 5]
    z = 0.3 + sum(w[i] * a for i, a in zip(at, x)) + sum(v[at[i]] @ v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert abs(quality.fm_score(at, x, 0.3, w, v) - 1 / (1 + np.exp(-z))) < 1e-12


def test_html():
    page = (
        '<html><head><title>t</title><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies, accept?</div><nav><a href=x>Home</a></nav>'
        "<article><h1>A &amp; B</h1><p>First   part, with\n<b>bold</b> words.<p>Second<br>part.<form>mail <input></form><div class=comments><p>Great, thanks!</p></div></article><footer>&copy; me</footer>"
    )
    assert html_text.main_text(page) == "A & B\n\nFirst part, with bold words.\n\nSecond part."
    plain = (
        '<div id="menu"><a href=x>Home</a></div><div class="c"><h2>Title</h2><p>Some long text, with commas, and words that go on. And on it goes.<p>Second is long enough too, we hope; it has words.'
        '<ul><li>one<li>two</ul></div><div class="comments"><p>I like this text very much, thanks for it.</p></div><div>Copyright 2020</div>'
    )
    assert html_text.main_text(plain).split("\n\n")[0] == "Title" and html_text.main_text(plain).endswith("one\n\ntwo") and "Copyright" not in html_text.main_text(plain)
    assert html_text.main_text("") == html_text.main_text(None) == html_text.main_text("<p") == ""


def test_html_ratios_decide():
    body = [f"Sentence {i} of the story, which goes on, and on; it has many words, and stops here. " * 4 for i in range(4)]
    body = [b.strip() for b in body]
    story = "".join(f"<p>{b}</p>" for b in body)
    teasers = "".join(f"<article><h3>Teaser {i}</h3><p>Read this too.</p></article>" for i in range(4))
    assert html_text.main_text(f"<html><body><div class='story'>{story}</div><div class='more'>{teasers}</div></body></html>") == "\n\n".join(body)
    for name in ("content has-sidebar", "layout-sidebar-right", "article-header", "page-with-comments"):
        for tag in ("article", "div"):
            page = f"<html><body><div class='{name}'><{tag}>{story}</{tag}><div class='sidebar'><p>Other things, here.</p></div></div></body></html>"
            assert html_text.main_text(page) == "\n\n".join(body), (name, tag)


BODY = [("Sentence %d of the story, which goes on, and on; it has many words, and stops here. " % i * 4).strip() for i in range(4)]
STORY, WANTED = "".join(f"<p>{b}</p>" for b in BODY), "\n\n".join(BODY)


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<main><article>{STORY}</article><article class='comment'><p>I like it a lot, thanks; it is good, and fine. I shall come back.</p></article></main>", WANTED),
        (f"<main>{STORY}<div><h3>More</h3><p>Read this too.</p></div></main>", WANTED),
        (f"<main>{STORY}<div class='teaser'><p>Read this too, as it is long and has points; it goes on, and on, and on.</p></div></main>", WANTED),
        (f"<body><article><p data-x='a\">{STORY[3:]}</article>", WANTED),
        (f"<article><p title=\"it's\" alt=\"a > b\">{STORY[3:]}<p class='x>It's a dog's life</p></article>", WANTED + "\n\nIt's a dog's life"),
        (f"<article>{STORY}<div class='social-science'>{STORY}</div><p id='legal-history'>Of law.</p><p>Then <math><mi>x</mi></math> too.</p></article>", f"{WANTED}\n\n{WANTED}\n\nOf law.\n\nThen x too."),
        (f"<body><h1>Title</h1>{STORY}<ul><li>one<li>two</ul><div>Copyright 2020</div></body>", f"Title\n\n{WANTED}\n\none\n\ntwo"),
        (f"<article><h2><a href=x>Head</a></h2>{STORY}<ul><li><a href=a>Some other story</a><li><a href=b>And another</a></ul></article>", f"Head\n\n{WANTED}"),
        (f"<body><form id=page><div id=content>{STORY}</div><input></form></body>", WANTED),
    ],
)
def test_html_parts_of_articles(page, want):
    assert html_text.main_text(page) == want


LINKS = "<ul><li><a href=a>First one</a></li><li><a href=b>Second one</a></li></ul>"
READERS = "".join(f"<div><p>Reader {i} says: I liked this, very much, and it is good. Thanks, all, and more soon.</p></div>" for i in range(18))


@pytest.mark.parametrize(
    "inner,after,want",
    [
        ("<section><h2>Verdict</h2><p>Buy it.</p></section>", "", "Verdict\n\nBuy it."),
        ("<div class=callout><p>Buy it now.</p></div><p>The end.</p>", "", "Buy it now.\n\nThe end."),
        ("<div>Q: why?</div><div>A: so.</div><div>Q: who?</div>", "", "Q: why?\n\nA: so.\n\nQ: who?"),
        ("<div>Line one</div><div>Line two</div>", "", "Line one\n\nLine two"),
        (f"<h2>Sources</h2>{LINKS}", "", "Sources\n\nFirst one\n\nSecond one"),
        (f"<h2>Related articles</h2>{LINKS}", "", ""),
        ("<div><h3>You may also like</h3><p>This one.</p></div><div>The end.</div>", "", "The end."),
        (LINKS, "", ""),
        ("", f"<section id=comments class=comments>{READERS}</section>", ""),
        ("", '<div role="alertdialog"><p>We use cookies, and more, so accept them. Thanks.</p></div>', ""),
        ('<div style="color:red; display: none"><p>Unseen, text. Here.</p></div>', "", ""),
    ],
)
@pytest.mark.parametrize("tag", ["article", "div class=story"])
def test_html_keeps_the_whole_article(inner, after, want, tag):
    page = f"<body><nav><a href=x>Home</a></nav><{tag}><h1>Title</h1>{STORY}{inner}</{tag.split()[0]}>{after}<footer>foot</footer></body>"
    assert html_text.main_text(page) == "\n\n".join(x for x in ("Title", WANTED, want) if x)


def test_html_sections_of_unequal_size():
    page = f"<body><div id=page><div class=story><section><h1>T</h1>{STORY}</section><section><h2>Verdict</h2><p>Buy it.</p></section></div></div></body>"
    assert html_text.main_text(page) == f"T\n\n{WANTED}\n\nVerdict\n\nBuy it."


def test_html_without_ratios_is_empty(monkeypatch):
    page = f"<body><article>{STORY}</article></body>"
    assert html_text.main_text(page) == WANTED
    monkeypatch.setattr(html_text, "path_ratio", lambda length, points, nodes: np.zeros(len(length)))
    assert html_text.main_text(page) == ""


@pytest.mark.parametrize("part", ["<div>", "<a '", "<p x='a\">text ", "<b><div></b></x>", "<svg>", "<a href=x>", "<foo><p>x", "<!-- ", "<a b=", "<td>x", "<head>", "<h2>More</h2><div>"])
def test_html_work_grows_with_length_only(part):
    from time import process_time

    began = process_time()
    html_text.main_text(part * 10_000 + STORY + "</div>" * 10_000 + "' b")
    assert process_time() - began < 2


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (1, "u", "<article><p>x</article>"), (2, None, "<p>" + "word " * 50_000), (3, "v", "<<<>>&#x41;&bogus;<a <b")], "page_id long, url string, html string")
    got = html_text.extract_main_text(df.withColumn("text", F.lit("clash"))).toPandas()
    assert len(got) == 5 and (got.n_chars == got.text.str.len()).all() and "x" in set(got.text)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_html_test_pages(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    made = {r.page_id: r.text for r in html_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", r.html)[1])
        assert made[r.page_id] == "\n\n".join(t for x in parts if (t := re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip()))


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_secrets(spark, docs):
    got, text = secrets.scan_secrets(docs).collect(), {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            want = base_spans(text[r.doc_id])
            joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
    linked = {r.doc_id: r.spans for r in got}[13]
    assert linked == "ident:0:14,endpoint:15:28,bare:29:55"
    long = spark.createDataFrame([(1, "login: bob " + "A1" * 45), (2, "é " + "token=abcdefgh " * 3000 + "end")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.scan_secrets(long).collect()} == {1: "ident:0:10,bare:11:101", 2: ",".join(f"assign:{2 + 15 * i}:{16 + 15 * i}" for i in range(3000))}
    assert {r.doc_id: r.text for r in secrets.redact_secrets(long).collect()} == {1: "[secret] [secret]", 2: "é " + "[secret] " * 3000 + "end"}
    alone = spark.createDataFrame([(1, "AbCdEfGhIjKlMnOpQrStUvWx12"), (2, "login: bob"), (3, "login: bob " + "w " * 400 + "AbCdEfGhIjKlMnOpQrStUvWx12"), (4, "https://a.b only")], "doc_id long, text string")
    assert {r.spans for r in secrets.scan_secrets(alone).collect()} == {""}
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
    clean = secrets.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    kept = {r.doc_id: r for r in clean.collect() if r.doc_id is not None}
    assert kept[10].text == "[secret]\" cc by MIT License" and kept[10].n_chars == len(kept[10].text) and kept[10].base == "clash"
    assert kept[13].text == "[secret] [secret] [secret]" and kept[12].text == ODD[12] and kept[1].text is None


def test_linking_against_all_pairs(spark):
    """Texts with many parts at all distances: what is reported is what comparing all pairs of spans reports."""
    rng = np.random.default_rng(8)
    parts = ["login: user%d", "client_id=abc%d", "https://host%d.example/x", "AKIAABCDEFGHIJKL%04d", "AbCdEfGhIjKlMnOpQrSt%06d", "password = longenough%d", "0123456789abcdef0123456789%06d", "plain words and more"]
    texts = []
    for _ in range(150):
        text = ""
        for _ in range(int(rng.integers(1, 25))):
            p = parts[int(rng.integers(0, len(parts)))]
            text += (p % rng.integers(0, 9999) if "%" in p else p) + " é" * int(rng.integers(0, 2)) + " x" * int(rng.choice([1, 5, 60, 150, 199, 200, 201, 300])) + " "
        texts.append(text)

    def slow(text):
        python = lambda p: re.compile(p.replace("(?i)", "(?i:", 1).replace(')["\']?', '))["\']?', 1) if "(?i)" in p else p)
        weak = [(m.start(), 3, m.end()) for m in python(secrets.IDENT).finditer(text)] + [(m.start(), 4, m.end()) for m in re.finditer(secrets.ENDPOINT, text)]
        weak += [(m.start(), 5, m.end()) for m in re.finditer(secrets.BARE, text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        every = weak + base_spans(text)
        fits = lambda a, b: b[1] in ((1, 3, 4) if a[1] == 5 else (0, 2, 5)) and (b[2] <= a[0] or b[0] >= a[2]) and abs(a[0] - b[0]) <= 400
        return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base_spans(text) + [w for w in weak if any(fits(w, x) for x in every)]))

    texts += [f"password=abcdefgh1 {scheme}://u:p@h/x" for scheme in ("mongodb+srv", "x" * 40, "a", "9http", "Https", "+a1", "42", "z+9" * 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.scan_secrets(df).collect()
    assert {r.doc_id: r.spans for r in got} == {i: slow(t) for i, t in enumerate(texts)}
    assert [r.spans for r in sorted(got)][-8:] == [f"assign:0:18,endpoint:19:{19 + n}" for n in (22, 51, 12, 16, 16, 14)] + ["assign:0:18", "assign:0:18,endpoint:19:45"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLE_SQL["op4_secrets"]).fetchall())
    assert sum(r.n_linked for r in got) > 300 and any(r.n_linked == 0 for r in got)
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    for i, t in enumerate(texts):
        out, last = "", 0
        for a, b in [tuple(map(int, x.split(":")[1:])) for x in slow(t).split(",") if x]:
            if a >= last:
                out += t[last:a] + "[secret]"
            last = max(last, b)
        assert clean[i] == out + t[last:]


def slow_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, linked):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if linked(prints[i], prints[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    known = got.dropna(subset=["doc_id"])
    assert all(f"{slow_print(texts[i]):016x}" == f for i, f in zip(known.doc_id, known.fingerprint) if len(texts[i] or "") < 1000)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert {t for t, c in zip(known.doc_id, known.component_id) if c == 0} >= {0, 1, 2}


def test_simhash_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, size=60, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres[:40]:
        x = int(c)
        for _ in range(rng.integers(1, 12)):
            for b in rng.choice(64, size=rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints |= {int(centres[0]) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # a large group in one ball
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for tile in (simhash.TILE, 64):
        before, simhash.TILE = simhash.TILE, tile
        try:
            found = simhash.components(simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4)).collect()
        finally:
            simhash.TILE = before
        root = {r.node: r.root for r in found}
        mine = pd.Series([root.get(p, p) for p in signed])
        slow = pd.Series(slow_components(prints, lambda a, b: bin(a ^ b).count("1") <= 4))
        assert mine.groupby(slow).nunique().eq(1).all() and slow.groupby(mine).nunique().eq(1).all()


def shingle_set(text):
    """The distinct five-word shingles of a text; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_alike(a, b):
    return not (a or b) or len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("tile,shingles", [(simhash.WIDE_TILE, simhash.TILE_SHINGLES), (8, simhash.TILE_SHINGLES), (simhash.WIDE_TILE, 1000)])
def test_near_copies_go_and_others_stay(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(simhash, "WIDE_TILE", tile)
    monkeypatch.setattr(simhash, "TILE_SHINGLES", shingles)
    rng = np.random.default_rng(7)
    texts, group = [], []

    def changed(words, share):
        """Every word of one stretch replaced: about `share` of the shingles stay, the similarity is share / (2 - share)."""
        n = round(len(words) * (1 - share))
        at = int(rng.integers(0, len(words) - n))
        return [*words[:at], *(f"n{x}" for x in rng.integers(0, 10**9, n)), *words[at + n :]]

    for g in range(20):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        for share in (1, 0.97, 0.95, 0.94, 0.91):  # similarities of 0.8 and more
            texts.append(" ".join(changed(words, share)))
            group.append(g)
        for n, share in enumerate((0.85, 0.7)):  # below 0.74: no copies, the first within the doubtful radius
            texts.append(" ".join(changed(words, share)))
            group.append(1000 + 2 * g + n)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    for _ in range(40):  # one larger group, beyond a tile of 8
        texts.append(" ".join(changed(words, 0.98)))
        group.append(200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == sorted({g: i for i, g in reversed(list(enumerate(group)))}.values())
    roots = slow_components([shingle_set(t) for t in texts], slow_alike)
    assert kept == [i for i, r in enumerate(roots) if i == r]


def test_short_near_copies_all_go(spark):
    """Pairs of few shingles at a similarity of 0.8 and little more, and as many below it, beside texts that share a line."""
    rng = np.random.default_rng(17)
    texts, pairs = [], []
    new = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    line = new(7)
    for g in range(300):
        words = new(8)  # four shingles, and five with one word more: 0.8
        pairs.append((words, [*words, *new(1)], True))
        n = int(rng.integers(4, 40))
        words = new(n + 4)
        pairs.append((words, [*words, *new(n // 4)], True))  # n of n + n // 4
        pairs.append((words := new(n + 4), [*words, *new(n // 4 + 1)], n >= 0.8 * (n + n // 4 + 1)))
    for a, b, _ in pairs:
        texts += [" ".join(a), " ".join(b)]
    texts += [" ".join([*line, *new(4)]) for _ in range(200)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(len(texts))) - {2 * i + 1 for i, (_, _, alike) in enumerate(pairs) if alike}


def test_a_centre_with_most_links(spark):
    """Stars and chains, a third of all links at one node, however its links are dealt."""
    rng = np.random.default_rng(4)
    links = [(0, i) for i in range(1, 400)] + [(10_000, i) for i in range(500, 900)] + [(i, i + 1) for i in range(1000, 1040)] + [(899, 1040)]
    links += [tuple(rng.integers(2000, 2400, 2).tolist()) for _ in range(300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    names = sorted({x for pair in links for x in pair})
    root = dict(zip(names, names))
    for _ in range(len(names)):
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert {n: got.get(n, n) for n in names} == root


def test_wide_fingerprint_of_odd_texts():
    sets = lambda text: np.unique(simhash.shingle_hashes(text, 5))
    for text in (None, "", " \t\n"):
        assert len(sets(text)) == 0 and not simhash.wide_fingerprint(sets(text)).any()
    assert (simhash.wide_fingerprint(sets("a b c d e f")) == simhash.wide_fingerprint(sets("A B  c d e f"))).all()
    long = " ".join(f"w{i}" for i in range(20_000))
    assert np.bitwise_count(simhash.wide_fingerprint(sets(long))).sum() > 300
    h = simhash.shingle_hashes("a b c d e f g a b c d e f g a b c d e f g", 5)
    assert len(h) == 17 and len(np.unique(h)) == 7


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=256).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 256
    by_place = got.sort_values(["sequence_id", "offset"])
    assert (by_place.offset == by_place.groupby("sequence_id").length.cumsum() - by_place.length).all()
    assert sorted(by_place.sequence_id.unique()) == list(range(by_place.sequence_id.nunique()))
    for r in docs.where("doc_id IS NOT NULL AND doc_id <> 6").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        mine = got[got.doc_id == r.doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert [crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()) for a, n in zip(mine.start, mine.length)] == list(mine.ids_crc32)
    assert len(got[(got.doc_id == 6)]) == 2 and len(got[got.doc_id.isna()]) == 3
    assert packing.pack(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing_of_long_white_space_and_equal_rows(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [" " * 1_000_000, "a" + "\n" * 300_000 + "b"] + ["same text"] * 40
    monkeypatch.setattr(packing, "PART_RUNS", 8)
    got = packing.pack(spark.createDataFrame([(None if i > 1 else i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path).toPandas()
    for i in (0, 1):
        ids = library.encode(texts[i], add_special_tokens=False).ids + [1]
        mine = got[got.doc_id == i].sort_values("start")
        assert [crc32(np.array(ids[a : a + n], dtype="<u4").tobytes()) for a, n in zip(mine.start, mine.length)] == list(mine.ids_crc32)
    assert got.doc_id.isna().sum() == 40 and not got.duplicated(["sequence_id", "offset"]).any()
    by_place = got.sort_values(["sequence_id", "offset"])
    assert (by_place.offset == by_place.groupby("sequence_id").length.cumsum() - by_place.length).all()


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        window = int(rng.integers(5, 60))
        lengths = sorted(rng.integers(1, window + 1, size=rng.integers(1, 80)).tolist(), reverse=True)
        bins = []
        for x in lengths:
            fit = [b for b in bins if window - sum(b) >= x]
            (min(fit, key=lambda b: window - sum(b)) if fit else (bins.append([]) or bins[-1])).append(x)
        counts = {x: lengths.count(x) for x in set(lengths)}
        places = packing.plan(counts, window)
        made = {}
        for k, (length, rank, first, each, offset) in enumerate(places):
            end = places[k + 1][1] if k + 1 < len(places) and places[k + 1][0] == length else counts[length]
            for r in range(rank, end):
                made.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
        assert all(sum(n for _, n in sorted(m)[:i]) == o for m in made.values() for i, (o, _) in enumerate(sorted(m)))
        assert sorted(sum(n for _, n in m) for m in made.values()) == sorted(map(sum, bins))


def slow_top(ids, x, k, every):
    out = []
    for i in [i for i in range(len(ids)) if ids[i] % every == 0]:
        scores = (x[i] * x).sum(axis=1)
        near = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(scores[j])) for r, j in enumerate(near)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[100:400] = x[100]  # one vector holds a third of all rows
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [None] + [1.0] * 11), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (None, [1.0] * 12), (2080, [])]
    return x, spark.createDataFrame(data + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1))


def test_exact_top_k(spark, vectors):
    x, df = vectors
    got = sorted((r.query_id, r.rank, r.vec_id, float(r.score)) for r in exact_topk.exact_top_k(df).collect())
    assert got == slow_top(np.arange(900), np.floor(x.astype(float) * 64), 20, 20)
    assert exact_topk.exact_top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-0.01])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in exact_topk.exact_top_k(few).orderBy("rank").collect()] == [(0, 1, 2**63 - 1), (0, 2, -(2**63))]


def test_nearest(spark, vectors):
    x, df = vectors
    got = sorted(map(tuple, nearest.nearest(df).collect()))
    want = slow_top(np.arange(900), x.astype(float), 20, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    zeros = spark.createDataFrame([(0, [0.0, 0.0]), (20, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nearest.nearest(zeros).collect()] == [(20, 1, 1, 0.0)]
    assert nearest.nearest(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [1e200 * (-1) ** i, 1e200, float(i)]) for i in range(41)], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nearest.nearest(huge).collect() if r.query_id == 0) == [(0, k + 1, 2 * k + 2) for k in range(20)]
    tiny = np.random.default_rng(9).normal(size=(300, 5))
    tiny[::2] *= 1e-170
    found = sorted(map(tuple, nearest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(tiny)], "vec_id long, embedding array<double>")).collect()))
    want = slow_top(np.arange(300), tiny, 20, 20)
    assert [g[:3] for g in found] == [w[:3] for w in want]


def test_word_bpe(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = word_bpe.encode_documents(docs, path, keep_text=True).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
            assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert word_bpe.encode_documents(docs.limit(0), path).count() == 0


def test_word_bpe_random_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), word_bpe.word_bpe(path)
    letters = st.sampled_from(list("abcdethionrsABE '’-.,!?0123456789éüñß_\n\t¼ªΣσ中😀") + ["<|endoftext|>", "'ll", "the", "ing"])

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(letters, max_size=60).map("".join))
    def same(text):
        assert mine.encode(text)[1] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))

    same()


def test_word_bpe_forgets_in_generations(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    bpe, texts = word_bpe.WordBpe(path), [" ".join(f"word{i % 7} other{i} {'long' * 20}{i}" for i in range(n, n + 30)) for n in range(0, 300, 10)]
    want = [bpe.encode(t) for t in texts]
    monkeypatch.setattr(word_bpe, "CACHE_WORDS", 40)
    small = word_bpe.WordBpe(path)
    assert [small.encode(t) for t in texts + texts] == want + want and len(small.counts) < 150 and not any(len(w) > word_bpe.CACHE_CHARS for w in small.counts)


def test_licenses_verify_the_order(spark):
    """Spans against a plain search for the longest chain of word pairs that runs on in text and template."""
    rng = np.random.default_rng(12)
    texts = ["cc by and by sa", "CC-BY-SA", "cc by x sa"]
    for phrase, _ in licenses.TEMPLATES:
        words = phrase.split()
        for kind in range(8):
            w = list(words)
            if kind == 1:
                rng.shuffle(w)
            if kind == 2:
                w = w[len(w) // 2 :] + w[: len(w) // 2]
            if kind > 2:
                for _ in range(kind - 2):
                    at = int(rng.integers(0, len(w)))
                    w = w[:at] + ["other"] + w[at + int(rng.integers(0, 2)) :]
            texts.append(" ".join(["some", "text", *w, "and", "more"]))
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.labels for r in found}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    assert sorted(map(tuple, found)) == sorted(con.execute(ORACLE_SQL["op10_licenses"]).fetchall())

    def slow(text):
        words, labels = re.findall("[a-z]+", text.lower()), set()
        for phrase, label in licenses.TEMPLATES:
            p = phrase.split()
            hits = sorted((i, -s) for i in range(len(words) - 1) for s in range(len(p) - 1) if words[i : i + 2] == p[s : s + 2])
            lines = {}
            for i, s in hits:
                lines.setdefault(i + s, []).append((i, s))
            if any(len(h) == len(p) - 1 for h in lines.values()):
                labels.add(label)
                continue
            order, islands = sorted(lines), []
            for d in order:
                (islands[-1] if islands and d - islands[-1][-1] <= 2 else islands.append([]) or islands[-1]).append(d)
            for isle in islands:
                chain = [0] * len(p)
                for i, s in sorted(h for d in isle for h in lines[d]):
                    chain[-s] = max(chain[-s], max(chain[:-s], default=0) + 1)
                if len(p) > 3 and max(chain) / (len(p) - 1) >= 0.8 and isle[-1] - isle[0] <= max(2, (len(p) - 1) // 2):
                    labels.add(label)
        return ",".join(sorted(labels))

    assert got == {i: slow(t) for i, t in enumerate(texts)}
    assert got[0] == "cc-by" and got[1] == "cc-by,cc-by-sa" and got[2] == "cc-by"


def test_licenses(spark, docs):
    more = ["MIT License", "cc by cc by", "The GNU General  Public-License GNU general public license. Apache\nlicense", "mit licenseé", "cc", "Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files", None]
    df = docs.select("doc_id", "text", "score", "pos").unionByName(spark.createDataFrame([(100 + i, t, "", "") for i, t in enumerate(more)] * 2, "doc_id long, text string, score string, pos string"))
    got = licenses.scan_licenses(df).collect()
    assert len(got) == df.count()
    texts = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is None:
            continue
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate({c: c + 32 for c in range(65, 91)}))
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None), ",".join(sorted({x for _, x in at})))
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert {r.labels for r in got if r.doc_id == 105} == {"mit"}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_prefixes_of_similar_sets_meet():
    """Sets of a similarity of 0.8 and more share a key under any counts, also exactly at 0.8."""
    rng = np.random.default_rng(23)
    counts = rng.integers(0, 50, 64)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        own = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
        a, rest = own[:n], own[n:]
        gone = int(rng.integers(0, n // 5 + 1))
        b = np.concatenate([a[gone:], rest[: int(rng.integers(0, n // 4 + 1))]])
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert len(np.intersect1d(simhash.prefix_of(np.unique(a), counts, 0.8), simhash.prefix_of(np.unique(b), counts, 0.8)))
    assert len(simhash.prefix_of(np.zeros(0, dtype=np.uint64), counts, 0.8)) == 0


def test_shingle_counts(spark):
    """Counts of texts by slot, repeats within a text once; empty and null texts have none."""
    simhash.prepare(spark)
    texts = ["a b c d e f a b c d e f", "a b c d e f", None, "", "x"]
    counts = simhash.shingle_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    slow = np.zeros(simhash.COUNTERS, dtype=np.int64)
    for t in texts:
        for h in set(simhash.shingle_hashes(t, 5).tolist()):
            slow[h % simhash.COUNTERS] += 1
    assert (counts == slow).all() and counts.sum() == 2 + 5 + 1 + 1
    assert simhash.shingle_counts(spark.createDataFrame([], "text string")).sum() == 0


def test_texts_that_share_most_of_their_passages_stay(spark):
    """Very frequent passages beside words of their own; only texts made of nothing else, and alike, go."""
    rng = np.random.default_rng(29)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(6)]
    texts = []
    for i in range(600):
        chosen = rng.permutation(6)[:3]
        own = [f"o{i}x{x}" for x in range(int(rng.integers(0, 60)))]
        texts.append(" ".join([*(w for k in sorted(chosen) for w in passages[k]), *own]))
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    roots = slow_components([shingle_set(t) for t in texts], slow_alike)
    assert kept == [i for i, r in enumerate(roots) if i == r]
