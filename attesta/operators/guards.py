"""Guards over questions and chunks, scopes and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import fixed
from attesta.functions.text import normalize_for_guard

SCOPE = ["tenant_id", "matter_id"]


def injected(normal: Column, document: bool) -> Column:
    return normal.rlike(fixed.INDIRECT_INJECTION if document else fixed.PROMPT_INJECTION) | normal.rlike(fixed.TEMPLATE_INJECTION)


def guard_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """With `normal`, `repaired` (normalizing changed the text) and `rejected` (an injected instruction or template)."""
    normal = questions.withColumn("normal", normalize_for_guard(text))
    return normal.withColumn("repaired", F.col("normal") != F.col(text)).withColumn("rejected", injected(F.col("normal"), False))


def scan_questions(questions: DataFrame, text: str = "normal") -> DataFrame:
    """The decision on each (normalized) question: question_id, rejected, injection, template, reason."""
    prompt, template = F.col(text).rlike(fixed.PROMPT_INJECTION), F.col(text).rlike(fixed.TEMPLATE_INJECTION)
    bad = F.coalesce(prompt | template, F.lit(False))
    reason = F.when(bad, fixed.SCAN_REASONS["rejected"]).otherwise(fixed.SCAN_REASONS["accepted"])
    return questions.select("question_id", bad.alias("rejected"), F.coalesce(prompt, F.lit(False)).alias("injection"), F.coalesce(template, F.lit(False)).alias("template"), reason.alias("reason"))


def select_sources(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs (question_id, scope, chunk_id) that questions (question_id, scope, doc_ids) may search: all of their scope, or only the selected documents, which are joined by id."""
    ids = F.coalesce("doc_ids", F.array().cast("array<string>")) if "doc_ids" in questions.columns else F.array().cast("array<string>")
    asked = questions.select("question_id", *SCOPE, ids.alias("ids"))
    own = chunks.select(*SCOPE, F.col("doc_id").cast("string").alias("id"), "chunk_id")
    every = asked.where("size(ids) = 0").drop("ids").join(own.drop("id"), SCOPE)
    some = asked.where("size(ids) > 0").select("question_id", *SCOPE, F.explode(F.array_distinct("ids")).alias("id")).join(own, [*SCOPE, "id"]).drop("id")
    return every.unionByName(some)


def own_corpora(questions: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with selected documents get a corpus of their own: (questions, chunks) whose matter_id names the question; others keep their scope.

    So every lane, and what it counts over a corpus, sees the selected documents only. A selection has at most 50 documents.
    """
    chosen = F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))) > 0
    name = F.concat_ws("::", "matter_id", F.lit("question"), F.col("question_id").cast("string"))
    asked = questions.withColumn("own", F.when(chosen, name))
    wanted = asked.where("own IS NOT NULL").select(*SCOPE, "own", F.explode(F.array_distinct("doc_ids")).alias("_id"))
    copies = chunks.withColumn("_id", F.col("doc_id").cast("string")).join(wanted, [*SCOPE, "_id"]).withColumn("matter_id", F.col("own")).select(*chunks.columns)
    return asked.withColumn("matter_id", F.coalesce("own", "matter_id")).drop("own"), chunks.unionByName(copies)


def without_sources(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """Questions of which no chunk may be searched: question_id, exit."""
    left = questions.join(selected.select("question_id").distinct().withColumn("some", F.lit(True)), "question_id", "left")
    return left.select("question_id", F.when(F.col("some").isNull(), "no sources").alias("exit"))


def effective_request(requests: DataFrame, top_k: int = fixed.TOP_K) -> DataFrame:
    """requests with tenant_id, matter_id and top_k as they hold: what is asked for, else the session's (session_tenant, session_matter), else the default; 0 counts as none."""
    return requests.withColumns({
        "tenant_id": F.coalesce(F.nullif(F.col("tenant_id"), F.lit("")), "session_tenant"),
        "matter_id": F.coalesce(F.nullif(F.col("matter_id"), F.lit("")), "session_matter"),
        "top_k": F.coalesce(F.nullif(F.col("top_k"), F.lit(0)), F.lit(top_k)),
    })


def guard_chunks(chunks: DataFrame) -> DataFrame:
    """With is_injected; done once for each chunk when it is indexed."""
    return chunks.withColumn("is_injected", injected(normalize_for_guard("text"), True))


def scan_hits(hits: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per question whether any retrieved chunk is injected: question_id, checked, rejected, rejected_chunk_ids."""
    joined = hits.select("question_id", *SCOPE, "chunk_id").join(flagged.select(*SCOPE, "chunk_id", "is_injected"), [*SCOPE, "chunk_id"], "left")
    ids = F.array_sort(F.collect_list(F.when(F.col("is_injected"), F.col("chunk_id"))))
    return joined.groupBy("question_id").agg(F.count("*").alias("checked"), ids.alias("rejected_chunk_ids")).withColumn("rejected", F.size("rejected_chunk_ids") > 0)


def scan_risks(texts: DataFrame, risks: DataFrame) -> DataFrame:
    """texts (question_id, text_id) with supplied risks (text_id, valid, risk): question_id, rejected, max_risk."""
    joined = texts.join(risks, "text_id", "left")
    return joined.groupBy("question_id").agg(F.max(F.coalesce(~F.col("valid"), F.lit(False))).alias("rejected"), F.max("risk").alias("max_risk"))


def matter_violation(own: str = "matter_id", asked: str = "on_matter") -> Column:
    return F.when(F.col(own) != F.col(asked), "session matter mismatch")


def scope_violations(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """rows (question_id, tenant_id, matter_id, ...) whose scope is not that of their question."""
    asked = scopes.select("question_id", F.col("tenant_id").alias("asked_tenant"), F.col("matter_id").alias("asked_matter"))
    return rows.join(asked, "question_id").where((F.col("tenant_id") != F.col("asked_tenant")) | (F.col("matter_id") != F.col("asked_matter"))).select(*rows.columns)


def assert_scope(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    if scope_violations(rows, scopes).head(1):
        raise ValueError("rows of another scope")
    return rows


def validate_requests(requests: DataFrame) -> DataFrame:
    """With `problems`: what is wrong with a request (question, doc_ids, top_k, tenant_id)."""
    n = F.length("question")
    checks = F.array(
        F.when(F.col("question").isNull() | ~n.between(1, 4000), F.lit("question length")),
        F.when(F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))) > 50, F.lit("too many doc_ids")),
        F.when(F.col("top_k").isNotNull() & ~F.col("top_k").between(1, 20), F.lit("top_k range")),
        F.when(~F.coalesce(F.col("tenant_id").rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False)), F.lit("tenant id")),
    )
    return requests.withColumn("problems", F.filter(checks, lambda x: x.isNotNull()))


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.POLICY, "role string, action string")


def authorize(requests: DataFrame) -> DataFrame:
    """requests (request_id, tenant_id, matter_id, roles, action, on_tenant, on_matter) with allowed and reason.

    The policy has nine rows, so its side is broadcast.
    """
    rules = F.broadcast(policy(requests.sparkSession))
    may = requests.select("request_id", "action", F.explode("roles").alias("role")).join(rules, ["role", "action"], "left_semi").select("request_id").distinct()
    joined = requests.join(may.withColumn("may", F.lit(True)), "request_id", "left")
    reason = (
        F.when(F.col("tenant_id") != F.col("on_tenant"), "tenant boundary").when(F.col("matter_id") != F.col("on_matter"), "matter mismatch").when(F.col("may").isNull(), "role not permitted")
    )
    return joined.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).drop("may")


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.PROBES, "suite string, probe string, text string, in_document boolean")


def block_probes(texts: DataFrame) -> DataFrame:
    """texts (suite, text, in_document): suite, blocked, total."""
    normal = normalize_for_guard("text")
    hit = F.when(F.col("in_document"), injected(normal, True)).otherwise(injected(normal, False))
    return texts.groupBy("suite").agg(F.sum(hit.cast("int")).alias("blocked"), F.count("*").alias("total"))
