"""Queries of this subpackage: name -> callable(spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm import copies, entries, mixing, nearsets, pieces, terms, tokens
from tripleloom.storage import shared_path, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with a freely typed object, each with the entry that it stands for or -1."""
    return entries.entries_found(table(spark, folder, "relation_examples"), table(spark, folder, "canonical_entries"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members of groups of equal triplets, each with the smallest id of its group."""
    return copies.copies_found(table(spark, folder, "relation_examples"))


def p2_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct triplet once, with its number of copies."""
    return copies.distinct_triplets(table(spark, folder, "relation_examples")).select("keep_id", "copies", "spellings")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of profiles whose summaries share at least three quarters of their words."""
    return nearsets.near_profiles(table(spark, folder, "item_profiles"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every profile with its group of similar summaries."""
    return nearsets.profile_groups(table(spark, folder, "item_profiles"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every profile that takes part, with its class of equal summaries and how many other profiles it is similar to."""
    return nearsets.linked_profiles(table(spark, folder, "item_profiles"))


def _counted(spark: SparkSession, folder: str) -> terms.TermCounts:
    """Counts of relation_examples: the rows that came in on time, then the late ones as a change of their own."""
    rows = table(spark, folder, "relation_examples").select("triplet", F.coalesce(F.col("ingested_at") - F.col("extracted_at") > F.expr("INTERVAL 1 DAY"), F.lit(False)).alias("late"))
    kept = terms.TermCounts(spark, shared_path(spark, "terms"))
    kept.apply(rows.where("NOT late"), change="on-time")
    kept.apply(rows.where("late"), change="late")
    return kept


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that too few or too many examples hold."""
    return _counted(spark, folder).marked().where("mark IS NOT NULL").select("term", "mark")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its number of occurrences and of examples."""
    return _counted(spark, folder).marked()


def p5_revised(spark: SparkSession, folder: str) -> DataFrame:
    """The counts after a change that deletes the examples without an item and cuts triplets of more than three elements to three."""
    rows = table(spark, folder, "relation_examples").select("iid", "triplet")
    kept = terms.TermCounts(spark, shared_path(spark, "terms"))
    kept.apply(rows, change="first")
    old = rows.where("iid IS NULL OR size(triplet) > 3")
    new = rows.where("iid IS NOT NULL AND size(triplet) > 3").withColumn("triplet", F.slice("triplet", 1, 3))
    kept.apply(old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1))), sign="sign", change="second")
    return kept.marked()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encoded(table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix, each as often as it occurs."""
    return _mix(spark, folder).records()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of tokens that the mix reaches."""
    return _mix(spark, folder).shares()


def p7_caps(spark: SparkSession, folder: str) -> DataFrame:
    """For each source of the mix, how many documents occur more often than they may, and how many other than floor(rate) or ceil(rate) times."""
    mix = _mix(spark, folder)
    times = mix.records().groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("last"))
    each = mix.documents.select("doc_id", "source").join(times, ["doc_id", "source"], "left").join(F.broadcast(mix.rates), "source")
    n = F.coalesce("n", F.lit(0))
    off = (n < F.floor("rate")) | (n > F.ceil("rate")) | (F.col("last") != F.col("n"))
    sums = each.groupBy("source").agg(F.sum((n > F.col("max_repeats")).cast("bigint")).alias("over_cap"), F.sum(F.coalesce(off, F.lit(False)).cast("bigint")).alias("off_rate"))
    found = mix.rates.join(sums, "source", "left")
    return found.select("source", "max_repeats", F.coalesce("over_cap", F.lit(0)).alias("over_cap"), F.coalesce("off_rate", F.lit(0)).alias("off_rate"), (F.col("rate") > F.col("max_repeats")).cast("bigint").alias("rate_over_cap"))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in pieces within the limits of their sources."""
    return pieces.pieces(table(spark, folder, "documents"), table(spark, folder, "split_limits"))


def p8_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Every document put together again from its pieces (a hash of the text, its length), and how many pieces are too large or share too little or too much."""
    limits = table(spark, folder, "split_limits")
    rows = p8_pieces(spark, folder).join(F.broadcast(limits), "source", "left")
    each = F.struct("piece_no", "start_token", "end_token", "start_char", "end_char", "text")
    one = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("ps"), F.first("max_tokens").alias("most"), F.first("overlap_tokens").alias("shared"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))
    text = F.aggregate("ps", start, lambda s, p: F.struct(F.concat(s["text"], F.coalesce(p["text"].substr((s["at"] - p["start_char"] + 1).cast("int"), F.lit(2**31 - 1)), F.lit(""))).alias("text"), p["end_char"].alias("at")))["text"]
    over = F.size(F.filter("ps", lambda p: p["end_token"] - p["start_token"] > F.col("most")))
    share = F.when((F.col("shared") > 0) & (F.col("shared") < F.col("most")), F.col("shared")).otherwise(0)
    shared = lambda p, i: F.try_element_at("ps", i)["end_token"] - p["start_token"]
    wrong = F.size(F.filter("ps", lambda p, i: (i > 0) & ((shared(p, i) < share) | (shared(p, i) > share + 3))))
    return one.select("doc_id", F.md5(text).alias("text_md5"), F.length(text).alias("n"), F.coalesce(F.when(F.col("most").isNotNull(), over), F.lit(0)).alias("over_limit"), wrong.alias("wrong_overlap"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p2_distinct": p2_distinct, "p3_found": p3_found, "p3_groups": p3_groups, "p3_links": p3_links, "p5_found": p5_found, "p5_counts": p5_counts, "p5_revised": p5_revised, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_caps": p7_caps, "p8_pieces": p8_pieces, "p8_rejoined": p8_rejoined}

_CORE = r"regexp_replace(lower({}), '[\s\x0B\x1C-\x1F\x{{85}}\x{{200B}}\p{{Z}}\p{{P}}]+', '', 'g')"
_CORES = "list_transform(triplet, lambda x: " + _CORE.format("x") + ")"

_WHOLE = f"""
cores AS (SELECT example_id, {_CORES} AS c FROM relation_examples WHERE len(triplet) = 3 AND triplet[1] IS NOT NULL AND triplet[2] IS NOT NULL AND triplet[3] IS NOT NULL),
whole AS (SELECT example_id, list_sort(c) AS c FROM cores WHERE c[1] <> '' AND c[2] <> '' AND c[3] <> '')"""

_TERMS = r"""
rows AS (SELECT example_id, x FROM (SELECT example_id, unnest(triplet) AS x FROM examples) WHERE x IS NOT NULL),
hits AS (SELECT example_id, lower(unnest(regexp_extract_all(x, '[\p{L}\p{N}]+'))) AS term FROM rows),
counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT example_id) AS examples FROM hits GROUP BY term),
marked AS (SELECT *, CASE WHEN examples < 3 THEN 'rare' WHEN examples > 0.05 * (SELECT count(*) FROM examples) THEN 'common' END AS mark FROM counted)"""

_ALL = "examples AS (SELECT example_id, triplet FROM relation_examples)"

_SETS = r"""
sets AS (SELECT doc_ord, list_distinct(list_transform(regexp_extract_all(business_summary::JSON ->> '$.summarization', '[\p{L}\p{N}]+'), lambda x: lower(x))) AS ws FROM item_profiles
  WHERE CASE WHEN json_valid(business_summary) THEN json_type(business_summary::JSON, '$.summarization') = 'VARCHAR' ELSE false END),
near AS (SELECT a.doc_ord AS a, b.doc_ord AS b FROM sets a JOIN sets b ON a.doc_ord < b.doc_ord AND len(a.ws) >= 8 AND len(b.ws) >= 8 AND least(len(a.ws), len(b.ws)) >= 0.75 * greatest(len(a.ws), len(b.ws))
  WHERE len(list_intersect(a.ws, b.ws)) >= 0.75 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))))"""

ORACLES: dict[str, str] = {
    "p3_found": f"WITH {_SETS} SELECT a AS doc_ord_a, b AS doc_ord_b FROM near",
    "p3_links": f"WITH {_SETS}, ends AS (SELECT a AS d FROM near UNION ALL SELECT b FROM near) SELECT doc_ord, min(doc_ord) OVER (PARTITION BY list_sort(ws)) AS class_id, coalesce(n, 0) AS links FROM sets LEFT JOIN (SELECT d, count(*) AS n FROM ends GROUP BY d) ON d = doc_ord WHERE len(ws) >= 8",
    "p2_found": f"WITH {_WHOLE} SELECT keep_id, example_id FROM (SELECT example_id, min(example_id) OVER (PARTITION BY c) AS keep_id FROM whole) WHERE example_id <> keep_id",
    "p2_distinct": f"WITH {_WHOLE} SELECT min(example_id) AS keep_id, count(*) AS copies, count(DISTINCT triplet) AS spellings FROM whole JOIN relation_examples USING (example_id) GROUP BY c",
    "p5_found": f"WITH {_ALL}, {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p5_counts": f"WITH {_ALL}, {_TERMS} SELECT term, occurrences, examples, mark FROM marked",
    "p5_revised": f"WITH examples AS (SELECT example_id, triplet[1:3] AS triplet FROM relation_examples WHERE iid IS NOT NULL), {_TERMS} SELECT term, occurrences, examples, mark FROM marked",
    "p7_caps": "SELECT source, max_repeats, 0 AS over_cap, 0 AS off_rate, 0 AS rate_over_cap FROM mix_targets",
    "p8_rejoined": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS n, 0 AS over_limit, 0 AS wrong_overlap FROM documents",
}
