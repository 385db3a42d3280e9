"""Writers of results and traces. The keys of a trace, the misspelt one included, are fixed values that its readers know."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.storage import merge_join


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def create_output(spark: SparkSession, path: str) -> None:
    """Fails if an output folder is there already."""
    if _exists(spark, path):
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {path}")


def write_results(results: DataFrame, path: str) -> None:
    """Result records (iid, triplets) as JSON lines in the order of doc_ord; create only."""
    results.orderBy("doc_ord").select("iid", "triplets").write.mode("errorifexists").json(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """Trace records as JSON lines in ASCII, nulls written out; create only."""
    trace.orderBy("index").write.mode("errorifexists").option("writeNonAsciiCharacterAsCodePoint", "true").option("ignoreNullFields", "false").json(path)


def export_array(spark: SparkSession, lines: str, file: str, indent: int = 2, ascii_only: bool = False) -> None:
    """One JSON array file from a folder of JSON lines, record by record in the folder's order; for results small enough for one file.

    An ``iid`` or ``item_id`` that is a plain integer is written as a number.
    """
    rows = spark.read.text(lines).toLocalIterator()
    with open(file, "x", encoding="utf-8") as out:
        out.write("[")
        for k, row in enumerate(rows):
            record = json.loads(row.value)
            for key in ("iid", "item_id"):
                if str(record.get(key) or "").isdecimal() and str(int(record[key])) == record[key]:
                    record[key] = int(record[key])
            body = json.dumps(record, indent=indent, ensure_ascii=ascii_only)
            out.write((",\n" if k else "\n") + "\n".join(" " * indent + x for x in body.split("\n")))
        out.write("\n]\n")


def trace_records(documents: DataFrame, hints: DataFrame, oie: DataFrame, definitions: DataFrame, canonical: DataFrame) -> DataFrame:
    """The trace of a pass, a record for each document.

    hints has (doc_ord, entity_hint, relation_hint), oie (doc_ord, triples), definitions (doc_ord, relation, definition), canonical
    (doc_ord, pos, s, p, o, canon, candidates). ``oie`` is what was extracted, never what became of it; a triple that could not be brought to
    the vocabulary is null in the last field.
    """
    maps = definitions.groupBy("doc_ord").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "definition")))).alias("schema_definition"))
    short = F.transform(F.coalesce("candidates", F.array().cast("array<struct<relation: string, definition: string, score: double>>")), lambda c: F.struct(c["relation"].alias("relation"), c["score"].alias("score")))
    each = F.struct("pos", short.alias("c"), F.when(F.col("canon").isNotNull(), F.array("s", "canon", "o")).alias("t"))
    rows = canonical.groupBy("doc_ord").agg(F.array_sort(F.collect_list(each), lambda a, b: a["pos"] - b["pos"]).alias("_all"))
    rows = rows.select("doc_ord", F.transform("_all", lambda x: x["c"]).alias("canonicalization_candidates"), F.transform("_all", lambda x: x["t"]).alias("schema_canonicalizaiton"))
    out = documents
    for part in (hints, oie, maps, rows):
        out = merge_join(out, part, "doc_ord", "left")
    none = F.array().cast("array<array<string>>")
    return out.select(
        F.col("doc_ord").alias("index"), F.coalesce("iid", F.col("doc_ord").cast("string")).alias("item_id"), F.col("text").alias("input_text"), "entity_hint",
        F.coalesce("relation_hint", F.lit("")).alias("relation_hint"), F.coalesce("triples", none).alias("oie"),
        F.coalesce("schema_definition", F.create_map().cast("map<string,string>")).alias("schema_definition"),
        F.coalesce("canonicalization_candidates", F.array().cast("array<array<struct<relation: string, score: double>>>")).alias("canonicalization_candidates"),
        F.coalesce("schema_canonicalizaiton", none).alias("schema_canonicalizaiton"),
    )
