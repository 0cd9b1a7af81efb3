"""Column expressions over texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from attesta.functions import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text: Column | str) -> Column:
    """Every run of white space becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(col(text), r"(?U)[\s\x1c-\x1f]+", " "))


def tokenize(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def canonical_tokens(tokens: Column | str) -> Column:
    """The distinct tokens, and those of more than three letters also without a final s."""
    t = col(tokens)
    return F.array_union(t, F.transform(F.filter(t, lambda x: (F.length(x) > 3) & x.endswith("s")), lambda x: F.substring(x, F.lit(1), F.length(x) - 1)))


def canonical_word(word: Column | str) -> Column:
    w = col(word)
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & w.endswith("es"), cut(2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), cut(1))
        .otherwise(w)
    )


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def normalize_for_match(text: Column | str) -> Column:
    """NFKC, one space for white space, trimmed, case-folded. ASCII texts stay in the JVM."""
    t = col(text)
    return F.when(t.rlike(r"[^\x00-\x7F]"), nfkc_casefold(F.when(t.rlike(r"[^\x00-\x7F]"), t))).otherwise(F.lower(clean_text(t)))


def normalize_for_guard(text: Column | str) -> Column:
    """Without zero-width and direction marks, NFKC, look-alike letters as Latin ones."""
    t = F.regexp_replace(col(text), fixed.ZERO_WIDTH, "")
    folded = F.when(t.rlike(r"[^\x00-\x7F]"), nfkc(F.when(t.rlike(r"[^\x00-\x7F]"), t))).otherwise(t)
    return F.translate(folded, fixed.LOOK_ALIKE_FROM, fixed.LOOK_ALIKE_TO)


def sentences(text: Column | str, definitions: bool = False) -> Column:
    """Trimmed sentences; for definitions only those that begin with a capital or digit after the break and end in . ! or ?"""
    pattern = r"(?<=[.!?])\s+(?=[A-Z0-9])" if definitions else r"(?<=[.!?])\s+"
    parts = F.transform(F.split(col(text), pattern, -1), clean_ends)
    return F.filter(parts, lambda s: s.rlike(r"[.!?]$") if definitions else s != "")


def clean_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def concepts(text: Column | str, pattern: str = fixed.CONCEPT) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1)), F.lower))


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), r"\s+"), lambda w: w != ""))


def content_terms(text: Column | str) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(clean_text(text)), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(fixed.DEFINITION_STOPWORDS))


def definition_object(question: Column | str) -> Column:
    """What a question asks to define, or an empty string."""
    q = F.lower(clean_text(question))
    first = F.regexp_extract(q, fixed.WHAT_IS, 1)
    return F.when(first != "", first).otherwise(F.regexp_extract(q, fixed.DEFINE, 1))


def definition_label(question: Column | str) -> Column:
    o = F.trim(definition_object(question))
    return F.when(o == "", "It").when(~o.contains(" ") & F.length(o).between(2, 6), F.upper(o)).otherwise(o)


def topic_terms(normal: Column) -> Column:
    words = F.regexp_extract_all(normal, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(fixed.TYPE_STOPWORDS)), canonical_word))


def type_objects(normal: Column) -> Column:
    return F.concat(F.regexp_extract_all(normal, F.lit(fixed.TYPES_OF), F.lit(1)), F.regexp_extract_all(normal, F.lit(fixed.SOME_TYPES), F.lit(1)))


def type_targets(normal_question: Column) -> Column:
    """Topic terms of all things whose types a (normalized) question asks for."""
    return F.array_distinct(F.flatten(F.transform(type_objects(normal_question), topic_terms)))


def match_spans(text: Column | str, pattern: str, block: int = 256) -> Column:
    """array<struct<start, end, value>> of a pattern's matches, in code points: the gaps between them come from split().

    Matches are placed within blocks and the blocks one after another, as appending each to one array would take time
    with the square of their number.
    """
    t, spans = col(text), "array<struct<start:int,end:int,value:string>>"
    gaps, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    both = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit"))), lambda x: x["hit"].isNotNull())
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(spans).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    def placed(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(pairs) / block).cast("int") - 1)
        after = lambda acc, b: F.concat(acc, F.array(F.aggregate(F.slice(pairs, b * block + 1, F.lit(block)), begin(F.element_at(acc, -1)["at"]), step)))
        return F.flatten(F.transform(F.aggregate(numbers, F.array(begin(F.lit(0))), after), lambda b: b["out"]))

    # transform() of one value names it, so that it is computed once
    return F.when(t.rlike(pattern), F.element_at(F.transform(F.array(both), placed), 1)).otherwise(F.array().cast(spans))
