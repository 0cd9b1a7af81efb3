"""The audit chain, metrics, evaluation and telemetry rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from attesta.functions import fixed
from attesta.functions.text import canonical_tokens, tokenize
from attesta.sources.scratch import cut

GENESIS = fixed.GENESIS
FIELDS = fixed.EVENT_FIELDS
EVENT = ["id", "tenant_id", "actor", "event_type", "payload", "created_at"]
CHAINED = "id long, tenant_id string, actor string, event_type string, payload string, created_at string, previous_hash string, event_hash string"


def redact_payload(payload: Column) -> Column:
    """A map's values of other than the allowed keys become a mark."""
    return F.transform_values(payload, lambda k, v: F.when(k.isin(fixed.AUDIT_KEYS), v).otherwise(F.lit("[redacted]")))


def scrub_attributes(attributes: Column) -> Column:
    return F.map_filter(attributes, lambda k, v: k.isin(fixed.KEPT_ATTRIBUTES) & ~k.isin(fixed.DELETED_ATTRIBUTES))


def linker(redact: bool):
    """A function of an event (a dict) and the previous hash that gives payload and hash; made here so that it travels to the workers by value.

    With redact, the payload's JSON keeps the values of allowed keys only, sorted and compact, before it is hashed; what
    is no JSON object is redacted as a whole.
    """
    fields, sha, allowed, mark = list(FIELDS), hashlib.sha256, frozenset(fixed.AUDIT_KEYS), "[redacted]"
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))

    def clean(payload: str | None) -> str:
        try:
            found = json.loads(payload or "{}")
        except ValueError:
            found = None
        return dump({k: v if k in allowed else mark for k, v in found.items()} if isinstance(found, dict) else mark)

    def link(row: dict, previous: str) -> tuple[str, str]:
        payload = clean(row["payload"]) if redact else row["payload"]
        body = row | {"payload": payload, "previous_hash": previous}
        return payload, sha(dump({k: body[k] for k in fields}).encode()).hexdigest()

    return link


@F.pandas_udf(StringType())
def _json_string(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else json.dumps(t))


def json_string(c: Column | str) -> Column:
    """A text as a JSON string with other than ASCII escaped; texts of plain characters stay in the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    odd = c.rlike(r'[^\x20-\x7E]')
    plain = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(odd, _json_string(F.when(odd, c))).otherwise(plain)


def event_digest(previous: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), json_string(previous if k == "previous_hash" else k)) for k in FIELDS]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def append_chain(events: DataFrame, chain: str = "tenant_id", redact: bool = True, tails: DataFrame | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """events (id, tenant_id, actor, event_type, payload, created_at), redacted, with previous_hash and event_hash, one chain per `chain`.

    tails (chain, tail, length): the last hash and the number of events of chains that go on; events then have their
    place in the chain as well (`place`, from 1). A chain is sequential by nature, so one chain is one task; chains run in parallel. A task reads its events sorted and
    batch by batch, and holds the last hash only.
    """
    names, link, genesis, out = list(EVENT), linker(redact), GENESIS, [*EVENT, "previous_hash", "event_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, previous, place = object(), genesis, 0
        for b in batches:
            rows, before, after, places = b.to_pylist(), [], [], []
            for r in rows:
                if r[chain] != key:
                    key, previous, place = r[chain], r.pop("tail", None) or genesis, r.pop("length", None) or 0
                r["payload"], digest = link(r, previous)
                place += 1
                places.append(place)
                before.append(previous)
                after.append(digest)
                previous = digest
            kept = [pa.array([r["payload"] for r in rows], pa.string()) if n == "payload" else b.column(n) for n in names]
            hashes = [pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *hashes, pa.array(places, pa.int64())], names=[*out, "place"])

    dealt = events.select(*names)
    if tails is not None:
        known = tails.select(F.col(chain).alias("_chain"), "tail", "length")
        dealt = dealt.join(known, dealt[chain].eqNullSafe(known["_chain"]), "left").drop("_chain")
    linked = dealt.repartition(F.col(chain)).sortWithinPartitions(chain, *order).mapInArrow(run, f"{CHAINED}, place long")
    return linked.drop("place") if tails is None else linked


def verify_chain(chained: DataFrame, chain: str = "tenant_id", rows: int = 1_000_000) -> DataFrame:
    """The first broken event of each chain, if any: chain, id, expected, actual.

    Each event is checked against the hash stored before it, so a chain is checked in ranges of ids, of about `rows`
    events, by as many tasks. A range's first event needs the last hash of the range before it; these are one row for
    each range and chain, exchanged in a step of their own.
    """
    spark = chained.sparkSession
    ranges = max(1, -(-chained.count() // rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = f"{chain}_range"
    # Dealt by (chain, id): a chain of many events goes over many partitions, in the order of its ids.
    placed = cut(chained.repartitionByRange(ranges, chain, "id").withColumn(at, F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(at, chain).orderBy("id")
    place = F.struct(F.col("id").isNotNull().alias("named"), "id")  # events without an id come first
    last = placed.groupBy(at, chain).agg(F.max_by("event_hash", place).alias("tail"))
    boundary = last.withColumn("carried", F.lag("tail").over(Window.partitionBy(chain).orderBy(at))).select(F.col(at).alias("_range"), F.col(chain).alias("_chain"), "carried")
    linked = placed.withColumn("inner", F.lag("event_hash").over(inside))
    both = linked.join(boundary, (linked[at] == boundary["_range"]) & linked[chain].eqNullSafe(boundary["_chain"]), "left")
    checked = both.withColumn("before", F.coalesce("inner", "carried", F.lit(GENESIS))).withColumn("expected", event_digest(F.col("before")))
    bad = checked.where((F.col("expected") != F.col("event_hash")) | (F.col("before") != F.col("previous_hash")))
    one = F.min_by(F.struct("id", "expected", F.col("event_hash").alias("actual")), place).alias("e")
    return bad.groupBy(chain).agg(one).select(chain, "e.*")


def recent(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(n)


def decisions(answered: DataFrame, guarded: DataFrame, flagged: DataFrame) -> DataFrame:
    """answered (answer_questions) with `guardrails`: array<struct<name, status, reason>> of the guards that each question met before its exit.

    guarded: guard_questions(); flagged: scan_hits() of what was retrieved.
    """
    own = guarded.select("question_id", F.col("repaired").alias("_repaired"), F.col("rejected").alias("_bad_input"))
    joined = answered.join(own, "question_id", "left").join(flagged.select("question_id", F.col("rejected").alias("_bad_hits")), "question_id", "left")
    status, exit_ = F.col("status"), fixed.EXITS
    named = lambda guard, state, reason: F.struct(F.lit(fixed.GUARDS[guard]).alias("name"), state.alias("status"), reason.alias("reason"))
    pick = lambda bad, yes, no, reasons: (F.when(bad, yes).otherwise(no), F.when(bad, reasons[yes]).otherwise(reasons[no]))
    reason = F.when(status == "accepted", fixed.REASONS["all hold"]).when(status == "rejected", fixed.REASONS["no quote"]).when(F.col("previous_status").isNotNull(), fixed.FALLBACK_REASON).otherwise(fixed.REASONS["dropped"])
    first = F.array(named("normalization", *pick(F.col("_repaired"), "repaired", "accepted", fixed.NORMAL_REASONS)), named("injection", *pick(F.col("_bad_input"), "rejected", "accepted", fixed.SCAN_REASONS)))
    early = status.isin("input rejected", "no sources")
    stopped = status.isin([k for k in exit_ if k != "rejected"])
    none = F.slice(first, 1, 0)
    more = F.when(early, none).otherwise(F.array(named("retrieved", *pick(F.col("_bad_hits"), "rejected", "accepted", fixed.RETRIEVED_REASONS))))
    last = F.when(stopped, none).otherwise(F.array(named("citations", status, reason)))
    return joined.withColumn("guardrails", F.concat(first, more, last)).drop("_repaired", "_bad_input", "_bad_hits")


def emit_audit(responses: DataFrame) -> DataFrame:
    """responses (request_id, status, guardrails array<struct<name, status, reason>>): the events of each request up to its exit, as request_id, step, event_type, guardrail, status, payload (JSON).

    A request that is stopped before it retrieves has its guards only; one that is stopped by what it retrieved has a
    retrieve event before them; all others go on with generate and chat. The payloads take what responses have of
    chunk_ids, doc_ids, matter_id, top_k, model_provider and model_version; tenant_id and actor stay beside them.
    """
    have = lambda c, kind: (F.col(c) if c in responses.columns else F.lit(None)).cast(kind)
    names = {"retrieved_chunk_ids": have("chunk_ids", "array<string>"), "selected_doc_ids": F.sort_array(have("doc_ids", "array<string>")), "matter_id": have("matter_id", "string"), "top_k": have("top_k", "int")}
    model = {"model_provider": have("model_provider", "string"), "model_version": have("model_version", "string")}
    json = lambda **parts: F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))
    event = lambda kind, guard, status, payload: F.struct(F.lit(kind).alias("event_type"), guard.cast("string").alias("guardrail"), status.cast("string").alias("status"), payload.alias("payload"))
    null, status = F.lit(None), F.col("status")
    guards = F.transform("guardrails", lambda g: event("guardrail", g["name"], g["status"], json(guardrail=g["name"], status=g["status"], reason=g["reason"])))
    nothing = F.slice(guards, 1, 0)
    retrieved, whole = ~status.isin("input rejected", "no sources"), ~status.isin([k for k in fixed.EXITS if k != "rejected"])
    before = F.when(retrieved, F.array(event("retrieve", null, null, json(**names)))).otherwise(nothing)
    request = {"request_id": F.col("request_id").cast("string"), "status": F.lit("ok"), "matter_id": names["matter_id"], **model}
    after = F.when(whole, F.array(event("generate", null, status, json(**model, status=status)), event("chat", null, F.lit("ok"), json(**request)))).otherwise(nothing)
    beside = [c for c in ("tenant_id", "actor") if c in responses.columns]
    each = responses.select("request_id", *beside, F.posexplode(F.concat(before, guards, after)).alias("step", "e"))
    return each.select("request_id", *beside, "step", "e.*")


def emit_uploads(documents: DataFrame) -> DataFrame:
    """documents (doc_id, tenant_id, matter_id, filename, chunk_count, pii_entities_redacted): one upload event each, as tenant_id, event_type, payload."""
    return documents.select("tenant_id", F.lit("upload").alias("event_type"), F.to_json(F.struct("doc_id", "matter_id", "filename", "chunk_count", "pii_entities_redacted")).alias("payload"))


def find_audit(events: DataFrame, guardrail: str, status: str) -> DataFrame:
    at = lambda k: F.get_json_object("payload_json", f"$.{k}")
    return events.where((F.col("event_type") == "guardrail") & (at("guardrail") == guardrail) & (at("status") == status))


def rate_by_window(events: DataFrame, by: str | list[str], minutes: int = 5, amount: str | None = None, slide: int | None = None) -> DataFrame:
    """Per window and label(s): window_start, labels, n, and the rate per second of events, or of the sum of `amount`. slide: minutes from one window's start to the next, if they overlap."""
    labels, w = [by] if isinstance(by, str) else list(by), F.window("ts", f"{minutes} minutes", f"{slide or minutes} minutes")
    much = F.sum(amount) if amount else F.count("*")
    return events.groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n"), much.alias("much")).select(F.col("w.start").alias("window_start"), *labels, "n", (F.col("much") / (minutes * 60)).alias("rate"))


def latency_quantile(events: DataFrame, q: float = 0.95, minutes: int = 5) -> DataFrame:
    return events.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.percentile("value", q).alias("quantile")).select(F.col("w.start").alias("window_start"), "quantile")


def quantile_sketches(events: DataFrame, by: list[str] | None = None, minutes: int = 1, k: int = 200) -> DataFrame:
    """Per window and label(s) a KLL sketch of `value`: window_start, labels, sketch, n. Sketches are added up later, so events are read once, whatever windows are asked for."""
    labels = list(by or [])
    held = events.where(F.col("value").isNotNull())
    return held.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), *labels).agg(F.kll_sketch_agg_double(F.col("value").cast("double"), k).alias("sketch"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *labels, "sketch", "n")


def sketched_quantile(sketches: DataFrame, q: float = 0.95, by: list[str] | None = None, minutes: int = 5, slide: int | None = None) -> DataFrame:
    """quantile_sketches() merged over longer windows: window_start, labels, n, quantile. Its rank is off by about 1.3 % of the window's events at most (k = 200)."""
    labels = list(by or [])
    w = F.window("window_start", f"{minutes} minutes", f"{slide or minutes} minutes")
    merged = sketches.groupBy(w.alias("w"), *labels).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(F.col("w.start").alias("window_start"), *labels, "n", F.expr(f"kll_sketch_get_quantile_double(sketch, {float(q)}D)").alias("quantile"))


def bucket_quantile(events: DataFrame, bounds: list[float], q: float = 0.95, minutes: int = 5) -> DataFrame:
    """The quantile of a histogram with these upper bounds (and one without): linear within its bucket, the last bound beyond it.

    Only the counts of the buckets leave a window's tasks, so this holds at any rate of events.
    """
    edges = F.array(*(F.lit(float(b)) for b in bounds))
    counts = [F.sum((F.col("value") <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)]
    cumulative = F.array(*(f"b{i}" for i in range(len(bounds))))
    hist = events.where(F.col("value").isNotNull()).groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("n"), *counts)
    ranked = hist.select(F.col("w.start").alias("window_start"), (F.col("n") * q).alias("rank"), cumulative.alias("c"))
    at = F.filter(F.transform("c", lambda c, i: F.when(c >= F.col("rank"), i)), lambda i: i.isNotNull())
    k = F.get(at, 0)
    low, before = F.when(k == 0, 0.0).otherwise(F.get(edges, k - 1)), F.when(k == 0, 0).otherwise(F.get("c", k - 1))
    inside = low + (F.get(edges, k) - low) * (F.col("rank") - before) / (F.get("c", k) - before)
    return ranked.select("window_start", F.when(k.isNull(), F.lit(float(bounds[-1]))).otherwise(inside).alias("quantile"))


def failure_alert(events: DataFrame, failed: Column, minutes: int = 5) -> DataFrame:
    return events.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.sum(failed.cast("int")).alias("failures")).where("failures > 0").select(F.col("w.start").alias("window_start"), F.col("failures").cast("long").alias("failures"))


def usage_counters(events: DataFrame) -> DataFrame:
    """events (tenant_id, event_type, status, provider, model, tokens): counters as rows (metric, tenant_id, label, value).

    Uploads by tenant, chats by tenant and status, tokens by tenant, provider and model, events by tenant and type, and
    failed verifications (a generation that is not accepted) by tenant: one pass, one shuffle.
    """
    kind = F.col("event_type")
    one = lambda when, metric, label, value: F.when(when, F.struct(F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value")))
    rows = F.array(
        one(kind == "upload", "uploads", F.lit(""), F.lit(1)),
        one(kind == "chat", "chats", F.coalesce("status", F.lit("")), F.lit(1)),
        one(F.col("tokens").isNotNull(), "tokens", F.concat_ws("/", F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit(""))), F.col("tokens")),
        one(kind.isNotNull(), "audit_events", kind, F.lit(1)),
        one((kind == "generate") & (F.coalesce("status", F.lit("")) != "accepted"), "verification_failures", F.lit(""), F.lit(1)),
    )
    each = events.select("tenant_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.metric", "tenant_id", "r.label", "r.value")
    return each.groupBy("metric", "tenant_id", "label").agg(F.sum("value").alias("value"))


def recall_hits(records: DataFrame, hits: DataFrame) -> DataFrame:
    """records (question_id, expected) with `hit`: whether the expected file is among the retrieved ones."""
    found = hits.select("question_id", F.col("filename").alias("expected")).distinct()
    yes = records.join(found, ["question_id", "expected"], "left_semi").withColumn("hit", F.lit(True))
    return records.join(yes, ["question_id", "expected"], "left").fillna(False, ["hit"])


def contains_terms(answer: Column | str, terms: Column | str) -> Column:
    """Whether an answer's canonical tokens hold those of every term (an array of texts)."""
    held = canonical_tokens(tokenize(answer))
    terms = F.col(terms) if isinstance(terms, str) else terms
    return F.forall(terms, lambda t: F.size(F.array_except(canonical_tokens(tokenize(t)), held)) == 0)


def evaluate(records: DataFrame, responses: DataFrame, hits: DataFrame, sparse: DataFrame) -> DataFrame:
    """One row of metrics: recall_at_8, faithfulness, citation_valid, bm25_recall_at_1, bm25_recall_at_8 and the lifts over both.

    records (question_id, expected: a file name), responses (question_id, status of the last guard, claims), hits and
    sparse (question_id, filename, rank) of the hybrid search and of BM25 alone.
    """
    near = lambda df, k, name: recall_hits(records, df.where(F.col("rank") <= k)).select("question_id", F.col("hit").cast("int").alias(name))
    cites = F.size(F.flatten(F.transform("claims", lambda c: c["citations"])))
    own = responses.select("question_id", (F.col("status") == "accepted").cast("int").alias("faithful"), (cites > 0).cast("int").alias("cited"))
    joined = near(hits, 8, "r8").join(near(sparse, 1, "b1"), "question_id").join(near(sparse, 8, "b8"), "question_id").join(own, "question_id", "left").fillna(0, ["faithful", "cited"])
    m = joined.agg(F.avg("r8").alias("recall_at_8"), F.avg("faithful").alias("faithfulness"), F.avg("cited").alias("citation_valid"), F.avg("b1").alias("bm25_recall_at_1"), F.avg("b8").alias("bm25_recall_at_8"))
    return m.withColumns({"lift_at_1": lift(F.col("recall_at_8"), F.col("bm25_recall_at_1")), "lift_at_8": lift(F.col("recall_at_8"), F.col("bm25_recall_at_8"))})


def render_rows(responses: DataFrame) -> DataFrame:
    """responses (request_id, status, answer, claims): request_id, event (error for what an exit stopped, else answer) and data, its JSON."""
    stopped = F.col("status").isin([k for k in fixed.EXITS if k != "rejected"])
    body = F.when(stopped, F.to_json(F.struct(F.col("status").alias("error"), F.col("answer").alias("message")))).otherwise(F.to_json(F.struct("answer", "claims")))
    return responses.select("request_id", F.when(stopped, "error").otherwise("answer").alias("event"), body.alias("data"))


def lift(value: Column, baseline: Column) -> Column:
    """Relative lift, at least 0; over a baseline of 0 it is 1, or 0 without a value."""
    return F.when(baseline <= 0, F.when(value > 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), (value - baseline) / baseline))


def sample_records(records: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n records by a seeded hash of their key: the same ones however the table is partitioned."""
    return records.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def gate_check(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    return metrics.join(thresholds, "metric").withColumn("passed", F.col("value") >= F.col("threshold"))


def reindex_required(configs: DataFrame, index: DataFrame, embedder: str, dim: int) -> DataFrame:
    """configs (tenant_id, embedder?, previous?, dim?) and index (tenant_id, embedder, dim): whether a scope must be embedded again."""
    eff = configs.select("tenant_id", F.coalesce("embedder", "previous", F.lit(embedder)).alias("e"), F.coalesce("dim", F.lit(dim)).alias("k"))
    joined = eff.join(index.select("tenant_id", F.col("embedder").alias("old_e"), F.col("dim").alias("old_k")), "tenant_id", "left")
    return joined.select("tenant_id", (~(F.col("e").eqNullSafe(F.col("old_e")) & F.col("k").eqNullSafe(F.col("old_k")))).alias("reindex"))
