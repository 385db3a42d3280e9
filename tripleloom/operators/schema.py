"""The vocabulary of relations: building it, growing it, and looking relations up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.storage import merge_join, small


def last_wins(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row for each relation: (ord, relation, definition, origin, extra...), the first place and the last definition.

    rows has ``ord``, unique, and ``relation``; columns that are missing come out null. Relations that differ in case are different; a null
    relation is left out; a null definition of the last row stays null.
    """
    names = ["definition", "origin", *(extra or [])]
    have = [c for c in names if c in rows.columns]
    last = F.max_by(F.struct(*have), "ord").alias("_last") if have else F.lit(None).alias("_last")
    one = rows.where("relation IS NOT NULL").groupBy("relation").agg(F.min("ord").alias("ord"), last)
    return one.select("ord", "relation", *[F.col(f"_last.{c}").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in names])


def known(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """The triples whose relation is in the vocabulary, exactly as written."""
    return triples.join(small(schema.select(F.col("relation").alias("p")), of=schema), "p", "left_semi")


def unknown(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """The triples whose relation is not in the vocabulary; those with a null relation are among them."""
    return triples.join(small(schema.select(F.col("relation").alias("p")), of=schema), "p", "left_anti")


def with_definitions(triples: DataFrame, definitions: DataFrame, normalize: bool = False) -> DataFrame:
    """Triples with ``definition``: the one of their relation in the same document, else null.

    Definitions are stripped where they are parsed; relations of triples are taken as they are unless ``normalize``.
    """
    key = F.trim("p") if normalize else F.col("p")
    d = definitions.select("doc_ord", F.col("relation").alias("_r"), "definition")
    return merge_join(triples.withColumn("_r", key), d, ["doc_ord", "_r"], "left").drop("_r")


def undefined(triples: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc_ord, relation): relations of a document without a definition."""
    used = triples.select("doc_ord", F.col("p").alias("relation")).distinct()
    return merge_join(used, definitions.select("doc_ord", "relation"), ["doc_ord", "relation"], "left_anti")


def upsert(schema: DataFrame, new: DataFrame) -> DataFrame:
    """The vocabulary with further relations (relation, definition, at) appended in order of ``at``, the first of each; known ones stay as they are.

    The additions of one step must be few enough for one ordered task, as vocabularies are.
    """
    fresh = new.join(small(schema.select("relation"), of=schema), "relation", "left_anti").groupBy("relation").agg(F.min_by("definition", "at").alias("definition"), F.min("at").alias("at"))
    start = F.broadcast(schema.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("_top")))
    ranked = fresh.withColumn("_n", F.row_number().over(Window.orderBy("at", "relation"))).join(start)
    rows = ranked.select((F.col("_top") + F.col("_n")).cast("bigint").alias("ord"), "relation", "definition", F.lit("enriched").alias("origin"))
    return schema.unionByName(rows, allowMissingColumns=True)
