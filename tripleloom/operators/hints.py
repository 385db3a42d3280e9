"""Hints for another pass over the documents: entities and relations that an earlier pass found, and relations that a text is near to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.similarity import nearest
from tripleloom.operators import groups
from tripleloom.operators.prompts import hint_line
from tripleloom.storage import merge_join, small


def united(previous: Column, retrieved: Column, k: int = 10) -> Column:
    """The previous relations, then up to k retrieved ones that are not among them; order kept, first occurrences stay. Null counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(previous, none), F.coalesce(retrieved, none)
    return F.array_distinct(F.concat(a, F.slice(F.array_except(b, a), 1, k)))


def retrieved(documents: DataFrame, vector: str, schema: DataFrame, k: int = 10, strategy: str = "matrix") -> DataFrame:
    """(doc_ord, retrieved): the k relations nearest to each document's vector, best first."""
    top = nearest(documents, ["doc_ord"], vector, schema.select("ord", "embedding"), k, strategy).join(small(schema.select("ord", "relation"), of=schema), "ord")
    return top.groupBy("doc_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "relation"))), lambda x: x["relation"]).alias("retrieved"))


def relation_hints(relations: DataFrame, schema: DataFrame, examples: DataFrame | None = None, texts: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """(doc_ord, relation_hint): one text for each document from its array ``relations``.

    Relations are numbered by their place in the array before those that are not in the vocabulary are left out, so numbers may have gaps. With
    numbered ``examples`` and the ``texts`` (doc_ord, text) they are from, each line names one, drawn for this document and relation. Texts are
    joined last, by the examples that were drawn. A document without relations has an empty text.
    """
    rows = relations.select("doc_ord", F.posexplode("relations").alias("at", "relation")).join(small(schema.select("relation", "definition"), of=schema), "relation")
    line = hint_line(F.col("at") + 1, F.col("relation"), F.col("definition"))
    if examples is not None:
        drawn = groups.drawn_examples(rows.select("doc_ord", "relation"), examples, seed)
        sources = merge_join(drawn, texts.select(F.col("doc_ord").alias("source"), "text"), "source", "left").select("doc_ord", "relation", "text", "triplet")
        rows = merge_join(rows, sources, ["doc_ord", "relation"], "left")
        line = hint_line(F.col("at") + 1, F.col("relation"), F.col("definition"), F.col("text"), F.col("triplet"))
    lines = rows.select("doc_ord", "at", line.alias("line"))
    text = lines.groupBy("doc_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "").alias("relation_hint"))
    return relations.select("doc_ord").join(text, "doc_ord", "left").select("doc_ord", F.coalesce("relation_hint", F.lit("")).alias("relation_hint"))


def merged_entities(found: Column, previous: Column) -> Column:
    """Two lists of entities as one, without repeats, in order: what a rule makes of a request to merge them."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(found, none), F.coalesce(previous, none))
