"""Models of the user's own in Spark tasks: extractors of pages, scanners, encoders, rerankers.

A hook is a function without arguments that makes the model: it runs once in each task, when the first rows come. The
model takes a list of inputs and returns a list of as many results; it gets one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from attesta.functions.text import clean_text

Model = Callable[[list], Sequence]


def with_model(rows: DataFrame, inputs: list[str], make: Callable[[], Model], name: str, kind: str) -> DataFrame:
    """rows with a column `name` of type `kind`: what the model gives for the inputs (a tuple of them, if there are several; nulls too)."""
    names = [c for c in rows.columns if c != name]
    result = _parse_datatype_string(kind)
    arrow = to_arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            if not b.num_rows:
                continue
            model = model or make()
            columns = [b.column(c).to_pylist() for c in inputs]
            got = list(model(columns[0] if len(columns) == 1 else list(zip(*columns))))
            if len(got) != b.num_rows:
                raise ValueError(f"the model gave {len(got)} results for {b.num_rows} inputs")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got, arrow)], names=[*names, name])

    schema = StructType([*(rows.schema[c] for c in names), StructField(name, result)])
    return rows.mapInArrow(run, schema)


def extract_pages(files: DataFrame, make: Callable[[], Model]) -> DataFrame:
    """files (doc_id, content): doc_id, page, text from a model that gives a list of (page, text) for each content; blank pages are left out."""
    found = with_model(files.select("doc_id", "content"), ["content"], make, "pages", "array<struct<page:int,text:string>>")
    return found.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page", "p.text").where(clean_text("text") != "")


def encode(texts: DataFrame, make: Callable[[], Model], dim: int, text: str = "text") -> DataFrame:
    """texts with `embedding` from a model that gives a list of numbers for each text (null for none); a vector of another size than dim is an error."""
    found = with_model(texts, [text], make, "embedding", "array<double>")
    wrong = F.raise_error(F.concat(F.lit(f"the encoder gave a vector of another size than {dim}: "), F.size("embedding").cast("string")))
    return found.withColumn("embedding", F.when(F.col("embedding").isNull() | (F.size("embedding") == dim), F.col("embedding")).otherwise(wrong))


def scan_with(texts: DataFrame, make: Callable[[], Model], text: str = "text") -> DataFrame:
    """texts with `valid` and `risk` from a scanner that gives (valid, risk) for each text."""
    found = with_model(texts, [text], make, "found", "struct<valid:boolean,risk:double>")
    return found.select(*texts.columns, "found.valid", "found.risk")


def rerank_with(candidates: DataFrame, make: Callable[[], Model], question: str = "question", text: str = "text") -> DataFrame:
    """candidates with `rerank_score` from a model that gives a number for each (question, text)."""
    return with_model(candidates, [question, text], make, "rerank_score", "double")
