"""Sets, lists and results of documents, from triples in long form (doc_ord, pos, s, p, o)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.storage import merge_join, small

#: Examples of a relation that may be sent to all tasks.
FEW = 64


def long_triples(df: DataFrame, triples: str = "triples", keys: tuple[str, ...] = ("doc_ord",)) -> DataFrame:
    """Nested triples as rows (keys, pos, s, p, o), pos from 0; a null triple keeps its row with null parts, missing parts are null."""
    rows = df.select(*keys, F.posexplode(triples).alias("pos", "t"))
    return rows.select(*keys, "pos", *[F.try_element_at("t", F.lit(i)).alias(c) for i, c in enumerate("spo", 1)])


def relations_of(triples: DataFrame) -> DataFrame:
    """(doc_ord, relations): the distinct relations of each document, sorted; nulls left out."""
    return triples.groupBy("doc_ord").agg(F.array_sort(F.collect_set("p")).alias("relations"))


def entities_of(triples: DataFrame) -> DataFrame:
    """(doc_ord, entities): the distinct subjects and objects of each document, sorted; nulls left out.

    Distinct values are found before they are gathered, so a document of many triples gathers no more than its entities.
    """
    return triples.select("doc_ord", F.explode(F.array("s", "o")).alias("e")).where("e IS NOT NULL").groupBy("doc_ord").agg(F.array_sort(F.collect_set("e")).alias("entities"))


def rectangular(triples: Column) -> Column:
    """Whether nested triples are a rectangle of three columns; empty is not."""
    return F.coalesce((F.size(triples) > 0) & F.forall(triples, lambda t: F.coalesce(F.size(t) == 3, F.lit(False))), F.lit(False))


def guarded_sets(df: DataFrame, triples: str = "triples") -> DataFrame:
    """(doc_ord, entities, relations) with the all-or-nothing rule: a document whose triples are no rectangle has empty lists."""
    t, ok = F.col(triples), rectangular(F.col(triples))
    part = lambda i: F.transform(t, lambda x: F.try_element_at(x, F.lit(i)))
    both = F.array_sort(F.array_distinct(F.concat(part(1), part(3))))
    none = F.array().cast("array<string>")
    return df.select("doc_ord", F.when(ok, both).otherwise(none).alias("entities"), F.when(ok, F.array_sort(F.array_distinct(part(2)))).otherwise(none).alias("relations"))


def nested(triples: DataFrame) -> DataFrame:
    """(doc_ord, triplets): the triples of each document as arrays in order of pos, duplicates kept."""
    return triples.groupBy("doc_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array("s", "p", "o").alias("t")))), lambda x: x["t"]).alias("triplets"))


def results(documents: DataFrame, triples: DataFrame) -> DataFrame:
    """(doc_ord, iid, triplets): a record for every document; null triples (those with a null relation) are gone, documents without triples have an empty list.

    The id is the item's own, or the document's number where it has none.
    """
    kept = nested(triples.where("p IS NOT NULL"))
    rows = merge_join(documents.select("doc_ord", F.coalesce("iid", F.col("doc_ord").cast("string")).alias("iid")), kept, "doc_ord", "left")
    return rows.withColumn("triplets", F.coalesce("triplets", F.array().cast("array<array<string>>")))


def examples_of(triples: DataFrame) -> DataFrame:
    """(relation, doc_ord, pos, triplet, text): the usage examples of each relation over the whole corpus, kept long so that no relation is one group.

    triples may have ``text`` too, the text of its document.
    """
    text = [F.col("text")] if "text" in triples.columns else []
    return triples.where("p IS NOT NULL").select(F.col("p").alias("relation"), "doc_ord", "pos", F.array("s", "p", "o").alias("triplet"), *text)


def first_examples(examples: DataFrame) -> DataFrame:
    """One example for each relation, the first by (doc_ord, pos)."""
    return examples.groupBy("relation").agg(F.min_by(F.struct("doc_ord", "pos", "text", "triplet"), F.struct("doc_ord", "pos")).alias("e")).select("relation", "e.*")


def numbered_examples(examples: DataFrame, blocks: int = 1024) -> DataFrame:
    """(relation, number, many, doc_ord, pos, triplet): the examples of each relation numbered from 0, and how many it has.

    Numbers go by (doc_ord mod blocks, doc_ord, pos); a block is numbered by itself and shifted by the sizes of those before it, so that no
    relation is one group.
    """
    placed = examples.select("relation", "doc_ord", "pos", "triplet", F.pmod("doc_ord", F.lit(blocks)).alias("_b"))
    counts = placed.groupBy("relation", "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("relation")
    offsets = counts.select("relation", "_b", F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("many"))
    inside = F.row_number().over(Window.partitionBy("relation", "_b").orderBy("doc_ord", "pos"))
    rows = merge_join(placed.withColumn("_in", inside), offsets, ["relation", "_b"])
    return rows.select("relation", (F.col("_off") + F.col("_in") - 1).alias("number"), "many", "doc_ord", "pos", "triplet")


def drawn_examples(wanted: DataFrame, numbered: DataFrame, seed: int) -> DataFrame:
    """(doc_ord, relation, source, pos, triplet): for each wanted (doc_ord, relation), both not null, one of all examples of the relation.

    The draw is made by a hash of the seed, the document and the relation, so it is another for each document and the same in each run. source
    and pos name the example; relations without examples give no rows.
    """
    many = small(numbered.groupBy("relation").agg(F.max("many").alias("many")))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_ord"), F.col("relation"))), 1, 15), 16, 10).cast("bigint")
    asked = wanted.select("doc_ord", "relation").distinct().join(many, "relation").withColumn("number", F.pmod(draw, F.col("many")))
    examples = numbered.select("relation", "number", "many", F.col("doc_ord").alias("source"), "pos", "triplet")
    few = F.col("many") <= FEW  # many documents share one of few examples
    some = asked.where(few).drop("many").join(small(examples.where(few).drop("many")), ["relation", "number"])
    rest = merge_join(asked.where(~few).drop("many"), examples.where(~few).drop("many"), ["relation", "number"])
    return some.unionByName(rest).select("doc_ord", "relation", "source", "pos", "triplet")
