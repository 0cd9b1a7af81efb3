"""Answers from retrieved chunks, and their verification against what was retrieved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.functions import fixed
from attesta.functions.text import canonical_word, clean_ends, content_terms, definition_label, definition_object, normalize_for_match, sentences, topic_terms, type_objects, type_targets, word_count
from attesta.sources.scratch import cut

CITATION = "array<struct<chunk_id:string,quote:string>>"
CLAIMS = f"array<struct<text:string,citations:{CITATION}>>"
#: What a verified citation takes from its chunk, and the claims that hold such citations.
SOURCE = {"doc_id": "string", "filename": "string", "tenant_id": "string", "matter_id": "string", "page": "int"}
VERIFIED = f"array<struct<text:string,citations:array<struct<chunk_id:string,quote:string,{','.join(f'{k}:{v}' for k, v in SOURCE.items())}>>>>"
LEAD = "Based on the retrieved source, "


def quote_answers(hits: DataFrame) -> DataFrame:
    """hits (question_id, question, rank, chunk_id, text): the best sentence of the first chunk as question_id, quote, answer, claims.

    Best: most distinct words shared with the question, then shortest, then first.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9]+"), F.lit(0)))
    first = hits.where("rank = 1").withColumn("s", sentences("text"))
    asked = words(F.col("question"))
    ranked = F.transform("s", lambda s, i: F.struct(F.when(F.size(asked) > 0, F.size(F.array_intersect(words(s), asked))).otherwise(0).alias("n"), F.when(F.size(asked) > 0, -F.length(s)).otherwise(0).alias("short"), (-i).alias("early"), s.alias("s")))
    quote = F.coalesce(F.array_max(ranked)["s"], F.trim("text"))
    out = first.select("question_id", "chunk_id", quote.alias("quote")).withColumn("answer", F.concat(F.lit(LEAD), "quote"))
    claims = F.array(F.struct(F.col("answer").alias("text"), F.array(F.struct("chunk_id", "quote")).alias("citations"))).cast(CLAIMS)
    return out.select("question_id", "quote", "answer", claims.alias("claims"))


PACKED = ["chunk_id", "doc_id", "filename", "page", "text"]


def prompt_pack(hits: DataFrame, instructions: str = fixed.INSTRUCTIONS) -> DataFrame:
    """One prompt per question: instructions, the question and its chunks as JSON, in rank order. A doc_id or page that hits lack or that is null is left out."""
    own = [c for c in PACKED if c in hits.columns]
    chunks = F.array_sort(F.collect_list(F.struct("rank", *own)))
    packed = hits.groupBy("question_id", "question").agg(chunks.alias("chunks"))
    body = F.to_json(F.transform("chunks", lambda c: F.struct(*(c[n].alias(n) for n in own))))
    return packed.select("question_id", F.concat(F.lit(f"{instructions}\n\nQuestion: "), "question", F.lit("\nSources: "), body).alias("prompt"))


def approx_tokens(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, tokens: the words of the question and of its chunks, at least 1."""
    of_chunks = hits.groupBy("question_id").agg(F.sum(word_count("text")).alias("n"))
    return questions.join(of_chunks, "question_id", "left").select("question_id", F.greatest(F.lit(1), word_count("question") + F.coalesce("n", F.lit(0))).cast("long").alias("tokens"))


#: What the answers of model services look like around their text.
ENVELOPE = "output_text string, output array<struct<content:array<struct<text:string>>>>, choices array<struct<message:struct<content:string>>>"


def response_text(envelope: Column) -> Column:
    """The text in a service's response (JSON): its output_text, else the first text of its output's contents, else the first message of its choices; null if there is none."""
    parsed = F.from_json(envelope, ENVELOPE, {"mode": "PERMISSIVE"})
    texts = F.flatten(F.transform(F.filter(parsed["output"], lambda o: o["content"].isNotNull()), lambda o: F.transform(o["content"], lambda c: c["text"])))
    messages = F.transform(parsed["choices"], lambda c: c["message"]["content"])
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), 0)
    return F.coalesce(parsed["output_text"], first(texts), first(messages))


def unwrap_responses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (question_id, response): answers for parse_answers (question_id, json), and the rejected ones (question_id, reason, response): without text, or with a text that is no answer."""
    found = raw.withColumn("json", response_text(F.col("response")))
    answer = F.get_json_object("json", "$.answer")
    reason = F.when(F.col("json").isNull(), fixed.REJECTS["no text"]).when(answer.isNull(), fixed.REJECTS["no answer"])
    marked = found.withColumn("reason", reason)
    return marked.where("reason IS NULL").select("question_id", "json"), marked.where("reason IS NOT NULL").select("question_id", "reason", "response")


def parse_answers(raw: DataFrame) -> DataFrame:
    """raw (question_id, json): answer, claims, and `malformed` for what is no answer: no JSON, or JSON without an answer text."""
    parsed = F.from_json("json", f"answer string, claims {CLAIMS}", {"mode": "PERMISSIVE"})
    return raw.select("question_id", parsed.alias("p")).select("question_id", "p.answer", F.coalesce("p.claims", F.array().cast(CLAIMS)).alias("claims"), F.col("p.answer").isNull().alias("malformed"))


def target_pattern(terms: Column) -> Column:
    ordered = F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])
    return F.concat(F.lit(r"\b(?:"), F.array_join(ordered, "|"), F.lit(r")\b"))


def support_score(text: Column, terms: Column) -> Column:
    """How well a (normalized) sentence defines the target terms."""
    own, p = content_terms(text), target_pattern(terms)
    has = lambda before, after: F.regexp_like(text, F.concat(F.lit(before), p, F.lit(after)))
    points = lambda ok, n: F.when(ok, n).otherwise(0.0)
    score = reduce(lambda x, y: x + y, (points(has(before, after), n) for before, after, n in fixed.SUPPORT))
    score += points(F.arrays_overlap(own, F.array(*map(F.lit, fixed.DEFINITION_NOUNS))), fixed.NOUN_POINTS) + points(F.arrays_overlap(own, F.array(*map(F.lit, fixed.DEFINITION_VERBS))), fixed.VERB_POINTS)
    return F.when(F.arrays_overlap(own, terms), score).otherwise(0.0)


def definition_answers(hits: DataFrame) -> DataFrame:
    """hits (question_id, question, rank, chunk_id, text): the sentence that best defines what a question asks for, if any does."""
    asked = hits.withColumn("terms", content_terms(definition_object("question"))).where(F.size("terms") > 0)
    each = asked.select("question_id", "question", "terms", "rank", "chunk_id", F.posexplode(sentences("text", definitions=True)).alias("pos", "quote"))
    normal = normalize_for_match("quote")
    scored = each.withColumn("normal", normal).withColumn("score", support_score(F.col("normal"), F.col("terms"))).where("score > 0")
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "rank", "pos")
    best = scored.withColumn("n", F.row_number().over(w)).where("n = 1")
    p, body = target_pattern(F.col("terms")), F.lit("")
    for before, after in fixed.DEFINES:
        got = F.regexp_replace(F.call_function("regexp_extract", F.col("normal"), F.concat(F.lit(before), p, F.lit(after + fixed.DEFINED)), F.lit(1)), r"[.!? ]+$", "")
        body = F.when(body != "", body).otherwise(got)
    label = definition_label("question")
    text = F.when(body != "", F.concat(label, F.lit(" is "), body, F.lit("."))).otherwise(F.concat(label, F.lit(" is described by the cited source.")))
    return best.select("question_id", text.alias("answer"), "chunk_id", "quote", "score")


def verify_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Each citation of answers (question_id, claims) with `verified`: its chunk was retrieved and holds the quote verbatim (normalized).

    A verified citation takes doc_id, filename, tenant_id, matter_id and page from that chunk, as far as hits have them.
    An empty quote passes, and is marked in empty_quote. A claim without citations is one row without chunk_id and cite.
    """
    claims = answers.select("question_id", F.posexplode("claims").alias("claim", "c")).select("question_id", "claim", F.col("c.text").alias("claim_text"), F.posexplode_outer("c.citations").alias("cite", "x"))
    cited = claims.select("question_id", "claim", "claim_text", "cite", "x.chunk_id", "x.quote")
    own = [(F.col(k) if k in hits.columns else F.lit(None)).cast(v).alias(k) for k, v in SOURCE.items()]
    held = hits.select("question_id", "chunk_id", normalize_for_match("text").alias("norm_text"), F.struct(*own).alias("source")).dropDuplicates(["question_id", "chunk_id"])
    joined = cited.join(held, ["question_id", "chunk_id"], "left").withColumn("norm_quote", normalize_for_match("quote"))
    ok = F.coalesce(F.col("norm_text").contains(F.col("norm_quote")), F.lit(False))
    marked = joined.withColumn("verified", ok).withColumn("empty_quote", F.col("norm_quote") == "")
    return marked.select("question_id", "claim", "claim_text", "cite", "chunk_id", "quote", "verified", "empty_quote", *(F.when(F.col("verified"), F.col("source")[k]).alias(k) for k in SOURCE))


def answers_type(question: Column, generated: Column, quotes: Column) -> Column:
    """Whether texts (normalized) answer a question about types: they speak of its targets, and the quotes state types of them."""
    targets = type_targets(question)
    stated = lambda text: F.filter(F.transform(type_objects(text), topic_terms), lambda t: F.size(t) > 0)
    on = lambda text: F.exists(stated(text), lambda t: F.arrays_overlap(t, targets))
    off = lambda text: F.exists(stated(text), lambda t: ~F.arrays_overlap(t, targets))
    words = F.regexp_extract_all(quotes, F.lit("[a-z0-9]+"), F.lit(0))
    both = F.arrays_overlap(topic_terms(F.concat_ws(" ", generated, quotes)), targets)
    # Modifiers of a target: the word before it, and words joined to that one by and / or.
    state = F.struct(F.array().cast("array<string>").alias("run"), F.lit(False).alias("linked"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, word: Column) -> Column:
        w = canonical_word(word)
        joins = w.isin("and", "or")
        counts = (F.length(w) > 2) & ~w.isin(fixed.TYPE_STOPWORDS) & ~F.array_contains(targets, w)
        one = F.when(counts, F.array(w)).otherwise(F.array().cast("array<string>"))
        run = F.when(joins, acc["run"]).when(acc["linked"], F.concat(acc["run"], one)).otherwise(one)
        found = F.when(F.array_contains(targets, w), F.array_union(acc["found"], acc["run"])).otherwise(acc["found"])
        return F.struct(run.alias("run"), joins.alias("linked"), found.alias("found"))

    modifiers = F.size(F.aggregate(words, state, step, lambda acc: acc["found"]))
    supported = on(quotes) | (~off(quotes) & (modifiers >= 2))
    return F.when(F.size(targets) == 0, True).otherwise(both & (on(generated) | ~off(generated)) & supported)


def verify_answers(answers: DataFrame, hits: DataFrame, questions: DataFrame) -> DataFrame:
    """answers (question_id, answer, claims): question_id, status, answer, dropped_claims, dropped_citations, reason, claims.

    A claim stands if it has a verified citation and answers the type that is asked for, if one is. dropped_citations
    counts the citations that are not verified and those of claims off the type; dropped_claims the latter claims only.
    Without a claim that stands the answer is rejected; without a dropped citation it is accepted as it is; else it is
    repaired, from the claims that stand. Their citations are the verified ones, with what they take from their chunks.
    """
    cites = verify_citations(answers, hits)
    one = F.struct("cite", F.struct("chunk_id", "quote", *SOURCE).alias("c"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("verified"), one))), lambda x: x["c"])
    by_claim = cites.groupBy("question_id", "claim", "claim_text").agg(F.count("cite").alias("cited"), kept.alias("kept"))
    joined = by_claim.join(answers.select("question_id", "answer"), "question_id").join(questions.select("question_id", "question"), "question_id", "left")
    norm = normalize_for_match
    quotes = F.array_join(F.transform("kept", lambda c: c["quote"]), " ")
    normal = joined.withColumns({"nq": norm(F.coalesce("question", F.lit(""))), "ng": norm(F.concat_ws(" ", "answer", "claim_text")), "nt": norm(quotes)})
    held = F.size("kept") > 0
    marked = normal.withColumn("good", held & F.coalesce(answers_type(F.col("nq"), F.col("ng"), F.col("nt")), F.lit(False)))
    own = clean_ends(F.coalesce("claim_text", F.lit("")))
    words = F.filter(F.transform("kept", lambda c: clean_ends(c["quote"])), lambda q: q != "")
    text = F.when(own != "", own).otherwise(F.array_join(words, " "))
    stands = F.struct("claim", text.alias("t"), F.struct(F.col("claim_text").alias("text"), F.col("kept").alias("citations")).alias("c"))
    grouped = marked.groupBy("question_id").agg(
        F.sum(F.when(held & ~F.col("good"), 1).otherwise(0)).alias("dropped_claims"),
        F.sum(F.when(F.col("good"), F.col("cited") - F.size("kept")).otherwise(F.col("cited"))).alias("dropped_citations"),
        F.array_sort(F.collect_list(F.when(F.col("good"), stands))).alias("good"),
    )
    out = answers.select("question_id", "answer").join(grouped, "question_id", "left").fillna(0, ["dropped_claims", "dropped_citations"])
    none, clean = F.coalesce(F.size("good") <= 0, F.lit(True)), F.col("dropped_citations") == 0
    status = F.when(none, "rejected").when(clean, "accepted").otherwise("repaired")
    texts = F.filter(F.transform("good", lambda g: g["t"]), lambda t: t != "")
    final = F.when(none, fixed.REFUSAL).when(clean, F.col("answer")).otherwise(F.array_join(texts, " "))
    reason = F.when(none & (F.col("dropped_claims") > 0), fixed.REASONS["off type"]).when(none, fixed.REASONS["no quote"]).when(clean, fixed.REASONS["all hold"]).otherwise(fixed.REASONS["dropped"])
    claims = F.coalesce(F.transform("good", lambda g: g["c"]), F.array()).cast(VERIFIED)
    return out.select("question_id", status.alias("status"), final.alias("answer"), F.col("dropped_claims").cast("long").alias("dropped_claims"), F.col("dropped_citations").cast("long").alias("dropped_citations"), reason.alias("reason"), claims.alias("claims"))


def definition_supported(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, supported: no definition is asked for, or a quote of the answer's claims gives one."""
    terms = questions.select("question_id", content_terms(definition_object("question")).alias("terms"))
    quotes = F.flatten(F.transform("claims", lambda c: F.transform(c["citations"], lambda x: x["quote"])))
    each = answers.select("question_id", F.explode_outer(quotes).alias("quote")).join(terms, "question_id").withColumn("normal", normalize_for_match("quote"))
    ok = (F.size("terms") == 0) | F.coalesce(support_score(F.col("normal"), F.col("terms")) > 0, F.lit(False))
    return each.groupBy("question_id").agg(F.max(ok).alias("supported"))


def definition_fallback(checked: DataFrame, hits: DataFrame, questions: DataFrame) -> DataFrame:
    """checked (verify_answers) where a definition is asked for and the answer is not accepted, or its verified quotes do not define it:

    the definition answer takes its place if it is accepted itself. question_id, status, answer, previous_status, claims.
    """
    own = definition_answers(hits).withColumn("claims", F.array(F.struct(F.col("answer").alias("text"), F.array(F.struct("chunk_id", "quote")).alias("citations"))).cast(CLAIMS))
    good = verify_answers(own.select("question_id", "answer", "claims"), hits, questions).where("status = 'accepted'").select("question_id", F.col("answer").alias("definition"), F.col("claims").alias("defined"))
    supported = definition_supported(checked.select("question_id", "claims"), questions)
    joined = checked.join(good, "question_id", "left").join(supported, "question_id", "left")
    swap = F.col("definition").isNotNull() & ((F.col("status") != "accepted") | ~F.coalesce("supported", F.lit(False)))
    pick = lambda new, old: F.when(swap, new).otherwise(F.col(old)).alias(old)
    return joined.select("question_id", pick(F.lit("repaired"), "status"), pick(F.col("definition"), "answer"), F.when(swap, F.col("status")).alias("previous_status"), pick(F.col("defined"), "claims"))


WORD_RUN = r"[\p{L}\p{N}\p{M}_]+"


def find_quotes(quotes: DataFrame, texts: DataFrame, words: int = 6) -> DataFrame:
    """Pairs (quote_id, id) where texts (id, text) hold a quote as a substring (both normalized).

    Candidates come from equi-joins with what each text surely holds if it holds the quote: the run of a quote's inner
    words (its first and last may be cut out of longer ones), the one of them that the fewest texts hold if there are few, or
    its first characters if there is none. A null or empty quote is found nowhere.
    """
    split = lambda c: F.regexp_extract_all(F.col(c), F.lit(WORD_RUN), F.lit(0))
    q = quotes.select("quote_id", normalize_for_match("quote").alias("nq")).where("nq <> ''").withColumn("w", split("nq"))
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    q = cut(q.withColumn("inner", inner).withColumn("tier", F.when(F.size("inner") >= words, F.lit(0)).when(F.size("inner") > 0, F.lit(-1)).otherwise(F.least(F.length("nq"), F.lit(3)))), "quotes")
    tiers = {r["tier"] for r in q.select("tier").distinct().collect()}  # at most five kinds
    t = cut(texts.select("id", normalize_for_match("text").alias("nt")).where("nt <> ''").withColumn("w", split("nt")), "texts")
    found = []
    for tier in sorted(tiers):
        asked = q.where(F.col("tier") == tier)
        if tier == 0:
            asked = asked.withColumn("key", F.xxhash64(F.array_join(F.slice("inner", 1, words), " ")))
            runs = F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
            keys = t.where(F.size("w") >= words).select("id", F.explode(F.array_distinct(runs)).alias("key"))
        elif tier == -1:
            keys = cut(t.select("id", F.explode(F.array_distinct("w")).alias("key")), "words")
            # A word that no text holds is the rarest: its quotes are found nowhere.
            known = keys.groupBy("key").agg(F.count("*").alias("df"))
            words_of = asked.select("quote_id", "nq", F.explode("inner").alias("key")).join(known, "key", "left")
            rarest = F.min_by("key", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key"))
            asked = words_of.groupBy("quote_id", "nq").agg(rarest.alias("key"))
        else:
            asked = asked.withColumn("key", F.substring("nq", F.lit(1), F.lit(tier)))
            keys = t.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.col("nt"), F.lit("(?s)(?=(.{%d}))" % tier), F.lit(1)))).alias("key"))
        pairs = asked.select("quote_id", "nq", "key").join(keys, "key").select("quote_id", "nq", "id").distinct()
        found.append(pairs.join(t.select("id", "nt"), "id").where(F.col("nt").contains(F.col("nq"))).select("quote_id", "id"))
    return reduce(DataFrame.unionByName, found).distinct() if found else q.select("quote_id", F.lit(None).cast(texts.schema["id"].dataType).alias("id")).limit(0)


def locate_quotes(pairs: DataFrame) -> DataFrame:
    """pairs (..., text, quote): start, end (code points, end exclusive), line_start, line_end of the quote; null where it is not found.

    The trimmed quote is looked for as it is, and only where that fails with any white space for its white space.
    """
    space = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
    text, clean = F.col("text"), F.regexp_replace("quote", f"^{space}|{space}$", "")
    literal = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))

    def hit(c: Column) -> Column:
        loose = F.call_function("regexp_extract", text, F.array_join(F.transform(F.split(c, space, -1), literal), space), F.lit(0))
        return F.when(c == "", F.lit("")).when(text.contains(c), c).otherwise(loose)

    # Newlines of n characters from a place on, by a plain replacement: one by a pattern would stop at each character.
    newlines = lambda at, n: n - F.length(F.replace(F.substring(text, at + 1, n), F.lit("\n"), F.lit("")))
    # transform() of one value names it, and a filter of the result is not moved below explode(): each step is computed once.
    each = lambda xs, **f: F.transform(xs, lambda x: F.struct(*(g(x).alias(k) for k, g in f.items())))
    own = {k: (lambda x, k=k: x[k]) for k in ("start", "end", "line_start")}
    found = each(F.transform(F.array(clean), hit), start=lambda h: F.when(h != "", F.instr(text, h) - 1), n=F.length)
    found = each(found, start=own["start"], end=lambda x: x["start"] + x["n"], line_start=lambda x: newlines(F.lit(0), x["start"]) + 1)
    found = each(found, **own, line_end=lambda x: x["line_start"] + newlines(x["start"], x["end"] - 1 - x["start"]))
    return pairs.select("*", F.explode(found).alias("_at")).select(*pairs.columns, *(f"_at.{k}" for k in (*own, "line_end")))


def source_excerpts(located: DataFrame, around: int = 2, preview: int = 120) -> DataFrame:
    """located (locate_quotes) with the lines around the quote: excerpt_start, excerpt_end (from 1), excerpt. Without a quote, the first lines."""
    lines = F.split("text", "\r?\n", -1)
    first = F.when(F.col("start").isNull(), 1).otherwise(F.greatest(F.col("line_start") - around, F.lit(1)))
    last = F.when(F.col("start").isNull(), F.least(F.size(lines), F.lit(preview))).otherwise(F.least(F.size(lines), F.col("line_end") + around))
    with_range = located.withColumn("excerpt_start", first).withColumn("excerpt_end", last)
    return with_range.withColumn("excerpt", F.array_join(F.slice(lines, F.col("excerpt_start"), F.col("excerpt_end") - F.col("excerpt_start") + 1), "\n"))


def locate_segments(matches: DataFrame, parts: DataFrame, bin_size: int = 1024) -> DataFrame:
    """matches (doc_id, start, end; perhaps page) in the text of parts (doc_id, pos, text; perhaps page) joined by spaces: the columns of matches, pos, part_start, part_end. Empty parts add no space.

    Where both have a page, each page is a text of its own. Matches and parts meet in bins of `bin_size` characters of a
    document: in each bin that a match touches it meets the parts that begin there, and the part that covers the
    bin's beginning, so a document with many of both does not pair them all.
    """
    keys = ["doc_id", *(["page"] if "page" in parts.columns and "page" in matches.columns else [])]
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = F.length(F.coalesce("text", F.lit("")))
    before = F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0)).over(w), F.lit(0))
    placed = parts.withColumn("n", own).withColumn("before", before).withColumn("from", F.when((F.col("n") == 0) & (F.col("before") > 0), F.col("before") - 1).otherwise(F.col("before"))).withColumn("to", F.col("from") + F.col("n"))
    # A range [a, b) takes the bins from its first character's to its last one's, an empty one that of its place.
    bins = lambda a, b: F.sequence(F.floor(a / bin_size), F.floor(F.greatest(b - 1, a) / bin_size))
    names = {k: F.col(k).alias(f"_{k}") for k in keys}
    held = placed.select(*names.values(), "pos", "n", "from", "to", F.explode(bins(F.col("from"), F.col("to"))).alias("_bin"), (F.floor(F.col("from") / bin_size)).alias("_first"))
    asked = matches.select("*", F.explode(bins(F.col("start"), F.col("end"))).alias("bin"), (F.floor(F.col("start") / bin_size)).alias("first"))
    same = reduce(lambda a, b: a & b, (asked[k].eqNullSafe(held[f"_{k}"]) for k in keys)) & (asked["bin"] == held["_bin"])
    # A pair that shares several bins counts in the first of them.
    once = F.col("bin") == F.greatest("first", "_first")
    hit = asked.join(held, same & once & (F.col("from") < F.col("end")) & (F.col("to") > F.col("start")))
    return hit.select(*matches.columns, "pos", F.greatest(F.col("start") - F.col("from"), F.lit(0)).alias("part_start"), F.least(F.col("end") - F.col("from"), F.col("n")).alias("part_end"))


def locate_quote_segments(quotes: DataFrame, parts: DataFrame) -> DataFrame:
    """quotes (doc_id, quote, ...) in the joined parts (doc_id, pos, text) of their document (or of their page, where both have a page): the ranges of the parts that they touch.

    A quote may run over the border of two parts.
    """
    keys = ["doc_id", *(["page"] if "page" in parts.columns and "page" in quotes.columns else [])]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    whole = parts.groupBy(*keys).agg(F.array_join(F.filter(ordered, lambda t: t != ""), " ").alias("text"))
    found = locate_quotes(quotes.join(whole, keys)).where("start IS NOT NULL").drop("text", "line_start", "line_end")
    return locate_segments(found, parts)


def answer_questions(questions: DataFrame, hits: DataFrame, guarded: DataFrame, flagged: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """All questions in one job, with their exits in order: input rejected, no sources, retrieved text rejected, else verified.

    guarded: guard_questions(); flagged: scan_hits() of the hits; answers: those of a model that ran elsewhere, else quotes
    of the hits. A question for a definition falls back on the sentence that defines it best. question_id, status, answer,
    previous_status, claims (with verified citations only).
    """
    if "question" not in hits.columns:
        hits = hits.join(questions.select("question_id", "question"), "question_id")
    hits = cut(hits, "hits")
    answers = quote_answers(hits) if answers is None else answers
    checked = definition_fallback(cut(verify_answers(answers, hits, questions), "checked"), hits, questions)
    joined = questions.select("question_id").join(guarded.select("question_id", F.col("rejected").alias("bad_input")), "question_id", "left").join(flagged.select("question_id", F.col("rejected").alias("bad_hits")), "question_id", "left").join(checked, "question_id", "left")
    exit_ = F.when(F.col("bad_input"), "input rejected").when(F.col("bad_hits").isNull(), "no sources").when(F.col("bad_hits"), "retrieved rejected").otherwise(F.coalesce("status", F.lit("rejected")))
    texts = F.create_map(*(F.lit(x) for pair in fixed.EXITS.items() for x in pair))
    through = ~exit_.isin([k for k in fixed.EXITS if k != "rejected"])
    claims = F.when(through, F.col("claims")).otherwise(F.array().cast(VERIFIED))
    return joined.select("question_id", exit_.alias("status"), F.coalesce(F.element_at(texts, exit_), "answer").alias("answer"), F.when(through, F.col("previous_status")).alias("previous_status"), F.coalesce(claims, F.array().cast(VERIFIED)).alias("claims"))
