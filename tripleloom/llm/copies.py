"""Problem 2: triplets that differ in spacing, case, punctuation or element order only.

Byte-identical raw triplets are collapsed first, with counts and before anything is shuffled twice; only the distinct survivors are brought
into canonical form (the three cores, sorted), and grouped once more on that full text, summing the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.text import core, whole_triplet
from tripleloom.storage import even_join, written


def raw_counts(examples: DataFrame) -> DataFrame:
    """(raw, copies, first_id): each byte-identical triplet once. Partial counts are made before the shuffle, so a hot triplet is no hot group."""
    return examples.where(F.col("triplet").isNotNull()).groupBy(F.col("triplet").alias("raw")).agg(F.count(F.lit(1)).alias("copies"), F.min("example_id").alias("first_id"))


def canonical(raw: DataFrame) -> DataFrame:
    """raw_counts with ``canon``, the sorted cores; rows that are no whole triplets are dropped."""
    return raw.where(whole_triplet(F.col("raw"))).withColumn("canon", F.array_sort(F.transform("raw", core)))


def distinct_triplets(examples: DataFrame) -> DataFrame:
    """One record for each distinct triplet: (keep_id, triplet, copies, spellings).

    keep_id is the smallest example_id of the group and triplet the raw form of that row; copies counts all rows of the group. Triplets that
    are null, not of three elements, or with a null or empty-core element take no part. An empty table gives an empty result.
    """
    groups = canonical(raw_counts(examples)).groupBy("canon").agg(
        F.min("first_id").alias("keep_id"), F.min_by("raw", "first_id").alias("triplet"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("spellings")
    )
    return groups.select("keep_id", "triplet", "copies", "spellings")


def copies_found(examples: DataFrame) -> DataFrame:
    """(keep_id, example_id): every member of a group of equal triplets but the one with the smallest id, with that id.

    example_id must be unique. The way back from a group to its rows goes over the raw form: raw forms that many rows share are sent by
    broadcast, of which there can be at most a thousand.
    """
    rows = examples.select("example_id", F.col("triplet").alias("raw"))
    survivors = written(canonical(raw_counts(rows.withColumnRenamed("raw", "triplet"))), "copies")
    groups = survivors.groupBy("canon").agg(F.min("first_id").alias("keep_id"), F.sum("copies").alias("n")).where("n > 1")
    keep = survivors.join(groups, "canon").select("raw", "copies", "keep_id")
    total = survivors.agg(F.sum("copies")).first()[0] or 0
    return even_join(rows, keep, ["raw"], "copies", total).where("example_id <> keep_id").select("keep_id", "example_id")
