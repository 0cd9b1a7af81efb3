"""Streams that go on after their first batch."""

from pyspark.sql import functions as F

from attesta.operators import chunks as C
from attesta.operators.index import Index
from attesta.sources.versions import Versions
from attesta.streaming import streams as R

PAGES = "doc_id long, tenant_id string, matter_id string, filename string, page int, text string"


def ingest(spark, at, *files, batches=1):
    """The files arrive and are read on the same checkpoint, so many a batch."""
    for rows in files:
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(f"{at}/in")
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", batches).parquet(f"{at}/in")
    R.ingest_stream(pages, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out")


def test_ingest_keeps_what_earlier_batches_wrote(spark, tmp_path):
    at = str(tmp_path)
    row = lambda i, text, tenant="t": (i, tenant, "m", f"{i}.txt", None, text)
    got = ingest(spark, at, [row(1, "first a@b.de"), row(7, "other", "u")], [row(2, "second")])
    assert sorted((r.tenant_id, r.doc_id, r.text) for r in got.collect()) == [("t", 1, "first <EMAIL>"), ("t", 2, "second"), ("u", 7, "other")]
    # a later run on the same checkpoint: a document comes again, one is blank, two have no id
    got = ingest(spark, at, [row(1, "x" * 2000), row(2, " ")], [row(None, "bare")], [row(None, "bare too"), row(3, "third", None)], [row(4, "fourth", None)]).collect()
    assert sorted((str(r.tenant_id), str(r.doc_id), r.ordinal, r.text[:8]) for r in got) == [
        ("None", "3", 0, "third"), ("None", "4", 0, "fourth"),
        ("t", "1", 0, "x" * 8), ("t", "1", 1, "x" * 8), ("t", "1", 2, "x" * 8), ("t", "2", 0, "second"), ("t", "None", 0, "bare"), ("t", "None", 1, "bare too"), ("u", "7", 0, "other"),
    ]
    assert len({r.chunk_id for r in got}) == len(got)


def test_ingest_batch_that_runs_again(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    ingest(spark, at, [(1, "t", "m", "1.txt", None, "first")])
    write = R.write_scope_partitions

    def fails(chunks, path):
        write(chunks.where(F.lit(False)), path)
        write(chunks.limit(1), path)  # the scope is replaced in part
        raise OSError("stopped")

    monkeypatch.setattr(R, "write_scope_partitions", fails)
    try:
        ingest(spark, at, [(None, "t", "m", "n.txt", None, "bare"), (2, "t", "m", "2.txt", None, "second")])
    except Exception as e:
        assert "stopped" in str(e)
    monkeypatch.undo()
    assert sorted(r.text for r in ingest(spark, at).collect()) == ["bare", "first", "second"]


def test_ingest_like_one_batch(spark, tmp_path):
    rows = [(i, f"t{i % 2}", "m", f"{i}.txt", None, f"text {i} " * 200) for i in range(6)]
    got = ingest(spark, str(tmp_path), *[[r] for r in rows])
    want = C.chunk_pages(C.redact_pii(spark.createDataFrame(rows, PAGES)))
    assert sorted((r.chunk_id, r.text) for r in got.collect()) == sorted((r.chunk_id, r.text) for r in want.collect())


FILES = "doc_id long, tenant_id string, matter_id string, filename string, content_type string, content binary"


def upload(spark, at, *files, batches=1):
    """The files arrive and are taken in on the same checkpoint, so many a batch."""
    for rows in files:
        spark.createDataFrame([(i, t, "m", f"{i}.txt", "text/plain", c) for i, t, c in rows], FILES).coalesce(1).write.mode("append").parquet(f"{at}/in")
    index = Index(Versions(spark, f"{at}/tables"))
    R.upload_stream(spark.readStream.schema(FILES).option("maxFilesPerTrigger", batches).parquet(f"{at}/in"), index, f"{at}/checkpoint").awaitTermination()
    return index


def held(index):
    """What the tables hold, without what is made up anew."""
    read = lambda name, *columns: sorted((tuple(r) for r in index.store.read(name).select(*columns).collect()), key=str)
    return {
        "documents": read("documents", "doc_id", "tenant_id", "filename", "content_type", "page_count", "chunk_count", "pii_entities_redacted"),
        "rejections": read("rejections", "doc_id", "tenant_id", "reason"),
        "pii": read("pii", "doc_id", "tenant_id", "entity_type", "start_offset", "replacement"),
        "chunks": sorted((tuple(r) for r in index.chunks().select("doc_id", "tenant_id", "ordinal", "text").collect()), key=str),
        "terms": sorted((r.tenant_id, r.term, r.df) for r in index.postings()[1].collect()),
        "scopes": sorted((r.tenant_id, r.n, round(r.avgdl, 6)) for r in index.postings()[2].collect()),
    }


def test_uploads_in_two_batches_and_again(spark, tmp_path):
    index = upload(spark, str(tmp_path), [(1, "t", b"first a@b.de here"), (2, "t", b" \n "), (7, "u", b"other")], [(1, "t", b"first again"), (3, "t", b"call 212-555-0101"), (None, "t", b"bare")])
    got = held(index)
    assert got["documents"] == [(1, "t", "1.txt", "text/plain", None, 1, 0), (3, "t", "3.txt", "text/plain", None, 1, 1), (7, "u", "7.txt", "text/plain", None, 1, 0), (None, "t", "None.txt", "text/plain", None, 1, 0)]
    assert got["rejections"] == [(2, "t", "document has no extractable text")]
    assert got["pii"] == [(3, "t", "PHONE_NUMBER", 5, "<PHONE>")]
    assert got["chunks"] == [(1, "t", 0, "first again"), (3, "t", 0, "call <PHONE>"), (7, "u", 0, "other"), (None, "t", 0, "bare")]
    assert ("t", "again", 1) in got["terms"] and ("t", "here", 1) not in got["terms"] and got["scopes"] == [("t", 3, 1.666667), ("u", 1, 1.0)]
    version = index.store.state()["version"]
    assert version == 2 and index.store.state()["batches"] == {"uploads": 1}
    # a batch that runs again changes nothing
    again = spark.createDataFrame([(9, "t", "m", "9.txt", "text/plain", b"late")], FILES)
    assert R.take_uploads(again, 1, index) == version and held(index) == got
    assert R.take_uploads(again, 2, index) == version + 1 and (9, "t", 0, "late") in held(index)["chunks"]


def test_an_upload_that_fails_is_taken_in_whole_later(spark, tmp_path, monkeypatch):
    index = upload(spark, str(tmp_path), [(1, "t", b"first")])
    before = held(index)

    def fails(*_):
        raise OSError("stopped")

    monkeypatch.setattr(Versions, "_publish", fails)
    try:
        upload(spark, str(tmp_path), [(1, "t", b"second a@b.de"), (2, "t", b"")])
    except Exception as e:
        assert "stopped" in str(e)
    assert held(index) == before
    monkeypatch.undo()
    got = held(upload(spark, str(tmp_path)))
    assert got["chunks"] == [(1, "t", 0, "second <EMAIL>")] and len(got["pii"]) == 1 and got["rejections"] == [(2, "t", "document has no extractable text")]


def test_uploads_by_another_extractor(spark, tmp_path):
    """Pages made elsewhere: here a page for each line."""
    index = Index(Versions(spark, f"{tmp_path}/tables"))
    lines = lambda files: files.select("doc_id", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    R.take_uploads(spark.createDataFrame([(1, "t", "m", "1.x", "x", b"one\ntwo\nthree"), (1, "t", "m", "1.x", "x", b"smaller hash or not")], FILES).limit(1), 0, index, lines)
    assert [(r.page, r.text) for r in index.chunks().orderBy("ordinal").collect()] == [(1, "one"), (2, "two"), (3, "three")] and index.store.read("documents").first().page_count == 3


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    """Sliding windows over three batches; a row that comes ten minutes after its windows closed counts in none."""
    at = str(tmp_path)
    for rows in ([("2024-01-01 10:00:00", "a"), ("2024-01-01 10:07:00", "a")], [("2024-01-01 11:00:00", "a")], [("2024-01-01 10:01:00", "a"), ("2024-01-01 10:58:00", "a")]):
        spark.createDataFrame(rows, "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(f"{at}/in")
        events = spark.readStream.schema("ts timestamp, kind string").parquet(f"{at}/in")
        R.run_to_table(R.rates_stream(events, "kind", 10, "10 minutes", 5), f"{at}/out", f"{at}/checkpoint", "update")
    seen = {}
    for b in range(8):
        try:
            found = spark.read.parquet(f"{at}/out/batch={b}").collect()
        except Exception:
            continue
        seen.update({r.window_start.strftime("%H:%M"): r.n for r in found})
    assert seen == {"09:55": 1, "10:00": 2, "10:05": 1, "10:50": 1, "10:55": 2, "11:00": 1}


def test_chains_over_batches(spark, tmp_path):
    """The chain of three batches, with a late event and one chain that holds nearly all, is that of one batch in the order of arrival; it goes on where it ended."""
    from attesta.operators import audit as U

    event = "id long, tenant_id string, actor string, event_type string, payload string, created_at string"
    rows = [(i, "hot" if i % 9 else None if i % 18 else "other", "a", "chat", '{"status":"ok","k":"v"}', f"2024-01-01T00:00:{i % 60:02d}") for i in range(400)]
    store = Versions(spark, f"{tmp_path}/tables")
    for part in (rows[:150], rows[150:151], rows[151:]):
        spark.createDataFrame(part, event).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        R.chain_stream(spark.readStream.schema(event).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint").awaitTermination()
    got = store.read("events").collect()
    assert len(got) == 400 and store.state()["batches"]["events"] == 2
    # the same events numbered by arrival, as one batch
    arrival = [r[0] for part in (rows[:150], rows[150:151], rows[151:]) for r in sorted(part, key=lambda r: (r[5], r[0]))]
    link, last, place = U.linker(True), {}, {}
    held = {r.id: r for r in got}
    for i in arrival:
        r = dict(zip(U.EVENT, rows[i]))
        before = last.get(r["tenant_id"], U.GENESIS)
        _, last[r["tenant_id"]] = link(r, before)
        place[r["tenant_id"]] = place.get(r["tenant_id"], 0) + 1
        assert (held[i].previous_hash, held[i].event_hash, held[i].place) == (before, last[r["tenant_id"]], place[r["tenant_id"]])
    assert {r.tenant_id: (r.tail, r.length) for r in store.read("tails").collect()} == {t: (last[t], place[t]) for t in last}
    version = store.state()["version"]
    assert R.take_events(spark.createDataFrame(rows[:5], event), 2, store) == version and store.read("events").count() == 400
