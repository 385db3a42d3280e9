"""Readers of documents, vocabularies, templates and earlier results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions.parsers import literal
from tripleloom.functions.text import strip
from tripleloom.operators.schema import last_wins


def _is_object(text: str | None) -> bool:
    try:
        return text is not None and isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


@F.pandas_udf(T.BooleanType())
def is_json_object(texts: pd.Series) -> pd.Series:
    """Whether a string as a whole is one JSON object: a scalar or an array is none, nor is an object with something after it; null gives false.

    Spark's own parser stops after the first value, so it cannot tell.
    """
    return texts.map(_is_object).astype(bool)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_ord, line): the lines of a text file or folder, numbered from 0 in the order of file names and lines.

    Lines are counted for each split of a file first; a line's number is the count of all splits before its own, and its place in it. Only the
    counts of splits are moved: packed in one array for each file, however many they are, they go to where the lines lie.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    inside = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)) - F.col("_first"))
    by_file = placed.groupBy("_file").agg(F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_start", "_in"))).alias("_off"))
    files = by_file.withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = F.broadcast(files.select("_file", "_before", "_off"))  # two numbers for each split
    return lines.join(offsets, "_file").select((F.col("_before") + F.try_element_at("_off", F.col("_start")) + F.col("_row")).alias("doc_ord"), "line")


def sniff(spark: SparkSession, path: str) -> str:
    """``jsonl`` if the first line is a JSON object, else ``text``; an empty file is text."""
    first = spark.read.text(path).limit(1).select(is_json_object(strip(F.col("value"))).alias("j")).first()
    return "jsonl" if first is not None and first.j else "text"


def text_documents(lines: DataFrame) -> DataFrame:
    """(doc_ord, iid, text): one document for each line, stripped; blank lines stay as empty documents; the id is the line's number."""
    return lines.select("doc_ord", F.col("doc_ord").cast("string").alias("iid"), strip(F.col("line")).alias("text"))


def json_documents(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_ord, iid, text), (doc_ord, line)): documents from JSON lines, and the lines that are no JSON objects.

    Three layouts, told apart line by line: ``iid`` with ``business summary``, itself a JSON string whose ``summarization`` is the text (empty
    if it has none or is no JSON as a whole); ``text`` with an optional ``id``; else the whole object as text. Ids that are missing are the line's number; ids of any
    JSON type come out as strings.
    """
    v = F.try_parse_json(strip(F.col("line")))
    body = F.try_variant_get(v, '$["business summary"]', "string")
    rows = lines.select("doc_ord", "line", v.alias("v"), is_json_object(strip(F.col("line"))).alias("ok"), is_json_object(body).alias("whole"))
    get = lambda path: F.try_variant_get("v", path, "string")
    summary = F.coalesce(F.when(F.col("whole"), F.try_variant_get(F.try_parse_json(get('$["business summary"]')), "$.summarization", "string")), F.lit(""))
    number = F.col("doc_ord").cast("string")
    review = get('$["business summary"]').isNotNull() & get("$.iid").isNotNull()
    plain = get("$.text").isNotNull()
    good = rows.where("ok").select(
        "doc_ord",
        F.when(review, get("$.iid")).when(plain, F.coalesce(get("$.id"), number)).otherwise(number).alias("iid"),
        F.when(review, summary).when(plain, get("$.text")).otherwise(strip(F.col("line"))).alias("text"),
    )
    return good, rows.where("NOT ok").select("doc_ord", "line")


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """((doc_ord, iid, text), rejects (doc_ord, line)) from a plain text or JSON lines file or folder, by its first line.

    In strict mode a line of a JSON file that is no JSON object raises instead of being set apart.
    """
    lines = numbered_lines(spark, path)
    if sniff(spark, path) == "text":
        return text_documents(lines), lines.limit(0)
    good, bad = json_documents(lines)
    if strict and not bad.isEmpty():
        raise ValueError(f"{path}: a line is no JSON object: {bad.first()}")
    return good, bad


def read_schema(spark: SparkSession, path: str | None) -> DataFrame:
    """(ord, relation, definition, origin) from a CSV file of two columns without a header; a blank path is an empty vocabulary.

    Quotes are doubled inside of quotes; a row with another number of fields fails the read. Of repeated relations the last definition counts,
    at the first place.
    """
    if not path:
        return spark.createDataFrame([], "ord bigint, relation string, definition string, origin string")
    rows = spark.read.csv(path, schema="relation string, definition string", mode="FAILFAST", escape='"')
    numbered = spark.createDataFrame(rows.rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1], "file")), "ord bigint, relation string, definition string, origin string")
    return last_wins(numbered)


def read_template(path: str) -> str:
    """A template or few-shot text, read whole on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def read_literal_results(spark: SparkSession, path: str) -> DataFrame:
    """(doc_ord, triplets) from a file of earlier results with one Python list of triples in each line; a line that is none has a null list."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def parsed(texts: pd.Series) -> pd.Series:
        def one(text: str):
            value = literal(text.strip())
            return [[None if x is None else str(x) for x in t] for t in value if isinstance(t, list)] if isinstance(value, list) else None

        return texts.map(one)

    return numbered_lines(spark, path).select("doc_ord", parsed("line").alias("triplets"))
