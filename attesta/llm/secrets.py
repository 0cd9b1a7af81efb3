"""Secret scans with multipart credential linking, in DataFrame operations only.

Three base kinds are found by pattern (assign, access, hex). Weak candidates are what alone proves nothing: identifiers
(user names, client ids), endpoints (URLs) and bare tokens. They are exploded to spans and interval-joined with the
complementary parts of their scope: a bare token is reported if an access identifier or endpoint starts within `near`
characters of it in the same text, an identifier or endpoint if a base secret or a bare token does. Weak spans never
change base ones.

Offsets without a UDF: split() gives the gaps between matches and regexp_extract_all() the matches, and a running sum of
lengths (code points) gives their places. Texts that cannot match a pattern skip it. Running sums and redaction go block
by block of matches, as appending to one array or text would take time with the square of their number.

Defined results: a null text is empty; a text without spans has zero counts, the digest of the empty string and empty
`spans`; repeated rows are scanned each; a null doc_id is kept; extra columns are ignored; an empty table gives an empty
result; spans that start together are in the order of their kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm._common import materialize

#: The base patterns.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: The method's own patterns.
IDENT = r"""((?i)access_?key(?:_?id)?|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})"""
#: A scheme is a whole run of letters, digits and plus signs with a letter in it, however long.
ENDPOINT = r"""(?<![A-Za-z0-9+])[0-9+]*+[A-Za-z][A-Za-z0-9+]*+://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+"""
BARE = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])"
KINDS = ["assign", "access", "hex", "ident", "endpoint", "bare"]
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Matches that a running sum or a redaction takes at a time.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def by_block(items: Column, state: Column, block: Callable[[Column, Column], Column]) -> Column:
    """The states after each block of items: block(items of the block, state before it) gives the next one."""
    numbers = F.sequence(F.lit(0), F.ceil(F.size(items) / BLOCK).cast("int") - 1)
    step = lambda acc, b: F.concat(acc, F.array(block(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)), F.element_at(acc, -1))))
    return F.slice(F.aggregate(numbers, F.array(state), step), F.lit(2), F.size(numbers))


def found(text: Column, pattern: str, kind: int, fit, gate: Column | None = None, group: int = 0) -> Column:
    """array<struct<start, kind, end>> of the pattern's leftmost matches; fit: of the group's text, whether a match counts."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    sized = F.zip_with(hits, parts, lambda h, p: F.struct(F.length(h).alias("n"), fit(p).alias("ok")))
    # The last gap has no match; it drops out as zip_with gives it a null length.
    steps = F.filter(F.zip_with(gaps, sized, lambda g, h: F.struct(F.length(g).alias("gap"), h["n"].alias("n"), h["ok"].alias("ok"))), lambda x: x["n"].isNotNull())
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    start = lambda at: F.struct(at.alias("at"), none.alias("out"))
    spans = bound(steps, lambda s: F.flatten(F.transform(by_block(s, start(F.lit(0)), lambda items, before: F.aggregate(items, start(before["at"]), step)), lambda b: b["out"])))
    gate = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(gate, spans).otherwise(none)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with `base` and `weak` (array<struct<start, kind, end>>) and `part_key`, the key of a row that has weak spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    yes = lambda s: F.lit(True)
    base = F.concat(found(text, ASSIGN, 0, lambda s: F.length(s) >= 8, group=2), found(text, ACCESS, 1, lambda s: F.length(s) >= 16, gate=text.contains("AKIA")), found(text, HEX, 2, yes))
    # Without an identifier or endpoint nothing can be linked, so nothing else weak is looked for.
    anchored = text.contains("://") | text.contains("AKIA") | text.rlike(IDENT)
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    weak = F.when(anchored, F.concat(found(text, IDENT, 3, yes), found(text, ENDPOINT, 4, yes, gate=text.contains("://")), found(text, BARE, 5, mixed)))
    rows = docs.withColumn("base", F.array_sort(base)).withColumn("weak", F.coalesce(weak, F.array().cast(SPANS)))
    key = F.md5(F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return rows.withColumn("part_key", F.when(F.size("weak") > 0, key))


def linked(rows: DataFrame, near: int) -> DataFrame:
    """Of rows with_spans(): part_key and `extra`, the weak spans with a complementary part within `near` characters."""
    some = rows.where(F.col("part_key").isNotNull())
    span = some.select("part_key", F.explode(F.concat("weak", "base")).alias("s")).select("part_key", "s.start", "s.kind", "s.end").distinct()
    cell = (F.col("start") / near).cast("int")
    left = span.where("kind >= 3").select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = span.select("part_key", cell.alias("cell"), F.col("start").alias("at"), F.col("end").alias("until"), F.col("kind").alias("other"))
    secret, place = F.col("other").isin(0, 2, 5), F.col("other").isin(1, 3, 4)
    complementary = ((F.col("kind") == 5) & place) | (F.col("kind").isin(3, 4) & secret)
    apart = (F.col("until") <= F.col("start")) | (F.col("at") >= F.col("end"))  # one span is not its own complement
    close = F.abs(F.col("start") - F.col("at")) <= near
    kept = left.alias("l").join(right.alias("r"), (F.col("l.part_key") == F.col("r.part_key")) & (F.col("l.cell") == F.col("r.cell")) & complementary & apart & close, "left_semi")
    return kept.select("part_key", "start", "kind", "end").distinct().groupBy("part_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("extra"))


def with_linked(rows: DataFrame, near: int) -> DataFrame:
    """rows with `extra`, their linked weak spans. Rows without weak spans, which have no key, are not shuffled."""
    none = F.array().cast(SPANS)
    some = rows.where(F.col("part_key").isNotNull()).join(linked(rows, near), "part_key", "left").withColumn("extra", F.coalesce("extra", none))
    return rows.where(F.col("part_key").isNull()).withColumn("extra", none).unionByName(some.select(*rows.columns, "extra"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, near: int = 400) -> DataFrame:
    """docs (doc_id, text, ...): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    out = with_linked(materialize(with_spans(docs.select("doc_id", "text")).drop("text"), "secret_spans"), near)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_linked"),
    )


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each run of overlapping spans (sorted by start)."""

    def block(items: Column, before: Column) -> Column:
        # Only the stretch of the text that these spans begin in is cut up.
        stretch = F.substring(text, before["at"] + 1, F.greatest(F.element_at(items, -1)["start"] - before["at"], F.lit(0)))
        begin = F.struct(before["at"].alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, s: Column, here: Column) -> Column:
            piece = F.concat(F.substring(here, acc["at"] - before["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        return bound(stretch, lambda here: F.aggregate(items, begin, lambda acc, s: step(acc, s, here)))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    tail = lambda states: F.substring(text, F.element_at(states, -1)["at"] + 1, F.length(text))
    whole = lambda states: F.concat(F.array_join(F.flatten(F.transform(states, lambda b: b["out"])), ""), tail(states))
    return bound(by_block(spans, first, block), whole)


def redact_secrets(docs: DataFrame, near: int = 400, mark: str = "[secret]") -> DataFrame:
    """docs with every span, base or linked, replaced by a mark (overlapping spans by one), and n_chars, if there, counted anew."""
    columns = docs.columns
    rows = materialize(with_spans(docs.select(F.struct(*columns).alias("row"), "doc_id", "text")), "secret_texts")
    every = with_linked(rows, near)
    spans = F.array_sort(F.concat("base", "extra"))
    text = F.when(F.size(spans) > 0, bound(spans, lambda s: without_spans(F.col("text"), s, mark))).otherwise(F.col("text"))
    cut = every.select("row", (F.size(spans) > 0).alias("changed"), text.alias("text"))
    out = {c: F.col("row")[c] for c in columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return cut.select(*(out[c].alias(c) for c in columns))
