"""Problem 1: freely typed values mapped to the entries of a reference list.

Token-level repair, then soft TF-IDF. The tokens of all distinct values, and what runs of neighbouring tokens spell together where blanks were
lost or misplaced, are joined with the vocabulary of the list by edit distance (an equality join on deletion neighbourhoods, verified by the
distance itself); the vocabulary holds the tokens of the entries and what each entry spells without blanks. Beginnings of the latter and short
forms of shared tokens are looked up the same way. All these are hits of one kind, a part of a value that stands for a part of an entry with a
similarity, and one soft TF-IDF ranks complete entries by them.

No list of words says what may stand beside an entry. That is learned from the values: a word seen beside many entries that do not own it is
free, a word of the list seen beside few others counts against every entry that lacks it. Everything is an equality join over distinct values;
no value is compared with the whole list.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions.text import core, whole_triplet
from tripleloom.storage import even_join, merge_join, small, written

#: Strings whose neighbourhoods a task makes.
PROBES = 4000

_RUN = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


@dataclass(frozen=True)
class Options:
    """min_score: least score of an entry that a value is mapped to; prefix_share: least part of an entry's letters that a cut-off value has;
    short: a token of fewer letters must match exactly; long: a token of as many letters may have two edits, in between one; swaps: in a token of
    as many letters both edits may involve swapped letters; abbreviation: the similarity of a token and its short form; free: beside so many
    entries a word stands that may also be written together with one."""

    min_score: float = 0.7
    prefix_share: float = 0.6
    short: int = 3
    long: int = 6
    swaps: int = 9
    abbreviation: float = 0.8
    free: int = 3


def fold(text: str) -> list[str]:
    """The tokens of a text, runs of letters and digits, in lower case and without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_INVISIBLE).lower()) if not unicodedata.combining(c))
    return _RUN.findall(plain)


def runs(tokens: list[str], most: int) -> Iterator[tuple[int, int, str]]:
    """(i, j, text): what the tokens from i up to j, j not included, spell together: every token, and runs of at most ``most`` letters."""
    for i, first in enumerate(tokens):
        yield i, i + 1, first
        j, text = i + 1, first
        while j < len(tokens) and len(text) + len(tokens[j]) <= most:
            text += tokens[j]
            j += 1
            yield i, j, text


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(fold)


_SPANS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("end", T.BooleanType()), T.StructField("s", T.StringType())]))


@F.pandas_udf(_SPANS)
def spans(texts: pd.Series, most: pd.Series) -> pd.Series:
    folded_ = [fold(t) for t in texts]
    return pd.Series([[{"i": i, "j": j, "end": j == len(ts), "s": s} for i, j, s in runs(ts, m)] for ts, m in zip(folded_, most)])


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A table made from the list, written once, and with a broadcast hint if it is small."""
    return small(written(df, name))


def _edits(c: Column, o: Options) -> Column:
    return F.when(F.length(c) < o.short, 0).when(F.length(c) < o.long, 1).otherwise(2)


def _deleted(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))


def _neighbourhood(c: Column, o: Options) -> Column:
    """The string with up to as many letters taken out as it may have edits."""
    one = _deleted(c)
    return (
        F.when(F.length(c) < o.short, F.array(c))
        .when(F.length(c) < o.long, F.array_distinct(F.concat(F.array(c), one)))
        .otherwise(F.array_distinct(F.concat(F.array(c), one, F.flatten(F.transform(one, _deleted)))))
    )


def repaired(probes: DataFrame, targets: DataFrame, o: Options) -> DataFrame:
    """(rel, s, t, d): each distinct probe string s with the targets t of its relation within the edits that both allow.

    Two strings within k edits, swaps of neighbours included, share a string that is left when up to k letters are taken out of each, so an
    equality join finds all of them. d is the edit distance where a swap is one edit; two edits that are swaps count a quarter more. Two
    letters in the place of one (as blurred print is read) are one edit and a quarter.
    """
    left = lambda c, v: F.length(c) - F.length(v)
    near = targets.select("rel", "t", F.explode(_neighbourhood(F.col("t"), o)).alias("v"))
    tasks = 1 + probes.count() // PROBES  # the neighbourhoods are a hundred times as many rows
    found = probes.repartition(tasks).select("rel", "s", F.explode(_neighbourhood(F.col("s"), o)).alias("v")).join(_kept(near, "near"), ["rel", "v"])
    found = found.groupBy("rel", "s", "t").agg(F.min(F.greatest(left("s", "v"), left("t", "v"))).alias("taken"))
    found = found.where(F.col("taken") <= F.least(_edits(F.col("s"), o), _edits(F.col("t"), o)))
    lev = F.levenshtein("s", "t", 4)
    long = F.least(F.length("s"), F.length("t")) >= o.swaps
    shared = lambda a, b: F.length(F.regexp_extract(F.concat(a, F.lit("\n"), b), r"^(.*).*\n\1", 1))
    ends = shared(F.col("s"), F.col("t")) + shared(F.reverse("s"), F.reverse("t"))
    blurred = (lev == 2) & (F.abs(F.length("s") - F.length("t")) == 1) & (ends >= F.least(F.length("s"), F.length("t")) - 1)
    d = F.when(F.col("taken") <= 1, F.col("taken").cast("double")).when(blurred, 1.25).when((lev >= 0) & (lev <= 2), 2.0).when((lev >= 0) & long, 2.25)
    return found.withColumn("d", d).where("d IS NOT NULL").select("rel", "s", "t", "d")


def _short_forms(vocabulary: DataFrame) -> DataFrame:
    """(rel, s, t): for words that several entries share, their beginnings, their consonants, and the short forms of up to four of their letters, the first included."""
    t = F.col("t")
    letters = lambda n: F.sequence(F.lit(2), F.length(t))
    pick = lambda c, i: F.concat(c, F.substring(t, i, F.lit(1)))
    first = F.array(F.struct(F.substring(t, 1, 1).alias("x"), F.lit(1).alias("at")))

    def longer(forms: Column) -> Column:
        return F.flatten(F.transform(forms, lambda f: F.transform(F.filter(letters(0), lambda i: i > f["at"]), lambda i: F.struct(pick(f["x"], i).alias("x"), i.alias("at")))))

    two = longer(first)
    three = longer(two)
    four = longer(three)
    begin = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, F.lit(1), i))
    bones = F.array(F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), "[aeiou]", "")))
    forms = F.array_distinct(F.concat(begin, bones, F.transform(F.concat(two, three, four), lambda f: f["x"])))
    return vocabulary.where((F.col("df") > 1) & (F.length(t) > 2)).select("rel", F.explode(forms).alias("s"), "t").where("s <> t")


def companions(singles: DataFrame, tokens: DataFrame, sums: DataFrame) -> DataFrame:
    """(rel, s, beside): of each token how many entries that do not own it it stands beside in the values.

    Only values are looked at that hold all tokens of an entry as they are; of several such entries those of most tokens count.
    """
    held = singles.select("rel", "vid", F.col("s").alias("t")).distinct().join(tokens, ["rel", "t"]).groupBy("rel", "vid", "entry_id").agg(F.count(F.lit(1)).alias("n"))
    held = held.join(sums.select("rel", "entry_id", "m"), ["rel", "entry_id"]).where("n = m")
    most = held.groupBy("vid").agg(F.max("m").alias("m"))
    anchored = merge_join(held, most, ["vid", "m"]).select("vid", "entry_id")
    pairs = merge_join(singles.select("rel", "vid", "s"), anchored, ["vid"]).select("rel", "s", "entry_id").distinct()
    other = pairs.join(tokens.withColumnRenamed("t", "s"), ["rel", "s", "entry_id"], "left_anti")
    return other.groupBy("rel", "s").agg(F.count(F.lit(1)).alias("beside"))


def mapped(values: DataFrame, entries: DataFrame, o: Options = Options()) -> DataFrame:
    """(rel, value, entry_id): for each distinct value the entry of its list that it stands for, or -1.

    values has ``rel`` and ``value``, each pair once, no nulls; entries has ``entry_id``, ``rel`` and ``entry_name``. A value stands for the
    entry of highest score, if that is at least ``o.min_score``; ties go to the fewer edits, then the smaller entry_id. The score is the soft
    TF-IDF share of the entry that hits in the value cover, each part by its similarity and all parts covered, less the weights of the
    value's other words that belong to the list. A hit's similarity is the share of letters that are right, for the beginning of an entry its
    Jaro similarity to the whole. Values without letters or digits stand for none. Very long values take part with all their tokens. An empty
    list maps all to -1.
    """
    e = written(entries.select("entry_id", "rel", folded("entry_name").alias("ts")).where(F.size("ts") > 0).withColumn("whole", F.array_join("ts", "")), "entries")
    tokens = _kept(e.select("rel", "entry_id", F.explode(F.array_distinct("ts")).alias("t")), "tokens")
    number = e.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("whole")).alias("most"))
    vocabulary = tokens.groupBy("rel", "t").agg(F.count(F.lit(1)).alias("df")).join(number, "rel").withColumn("idf", F.log(F.lit(1.0) + F.col("n") / F.col("df"))).drop("n", "most")
    vocabulary = _kept(vocabulary, "vocabulary")
    sums = _kept(tokens.join(vocabulary, ["rel", "t"]).groupBy("rel", "entry_id").agg(F.sum("idf").alias("all_idf"), F.count(F.lit(1)).alias("m")), "sums")

    lists = _kept(number.select("rel", "most"), "lists")
    v = written(values.select("rel", "value", F.monotonically_increasing_id().alias("vid")), "values")  # long values go no further than this
    parts = written(v.join(lists, "rel").select("rel", "vid", "most", F.inline(spans("value", F.col("most") + 2))), "spans")
    singles = parts.where("j = i + 1").select("rel", "vid", "i", "s")

    # words that stand beside many entries, and tokens that one of them is written together with
    beside = written(companions(singles, tokens, sums), "beside")
    free = beside.join(vocabulary.withColumnRenamed("t", "s"), ["rel", "s"], "left").where(F.col("beside") >= F.greatest(F.lit(o.free), 2 * F.coalesce("df", F.lit(0))))
    free = _kept(free.where(F.length("s") > 1).select("rel", F.col("s").alias("w")), "free")
    n, at = F.length("s"), F.col("at")
    reach = lists.join(free.groupBy("rel").agg(F.max(F.length("w")).alias("longest")), "rel")  # a longer token is no entry with a free word
    cuts = singles.where(n > 4).select("rel", "s").distinct().join(F.broadcast(reach), "rel").where(n <= F.col("most") + 2 + F.col("longest")).withColumn("at", F.explode(F.sequence(F.lit(2), n - 2)))
    cuts = cuts.select("rel", "s", F.inline(F.array(F.struct(F.substring("s", F.lit(1), at).alias("w"), F.substring("s", at + 1, n).alias("rest")), F.struct(F.substring("s", at + 1, n).alias("w"), F.substring("s", F.lit(1), at).alias("rest")))))
    glued = written(cuts.join(free, ["rel", "w"]).where(F.length("rest") > 2).select("rel", "s", "rest").distinct(), "glued")

    # what distinct parts of values may stand for: tokens of the list, and whole entries
    probes = parts.select("rel", "s", "most").unionByName(glued.join(lists, "rel").select("rel", F.col("rest").alias("s"), "most"))
    probes = written(probes.where(F.length("s") <= F.col("most") + 2).select("rel", "s").distinct(), "probes")
    wholes = e.select("rel", F.col("whole").alias("t"), "entry_id")
    targets = tokens.select("rel", "t").unionByName(wholes.select("rel", "t")).distinct()
    fixes = repaired(probes, targets, o).withColumn("sim", 1 - F.col("d") / F.length("t"))
    least = F.greatest(F.lit(3), F.ceil(o.prefix_share * F.length("t")).cast("int"))
    begin = F.transform(F.sequence(least, F.length("t") - 1), lambda i: F.substring("t", F.lit(1), i))
    starts = _kept(wholes.select("rel", "t").distinct().where(least < F.length("t")).select("rel", "t", F.explode(begin).alias("s")), "starts")
    share = F.length("s") / F.length("t")
    cut = probes.join(starts, ["rel", "s"]).select("rel", "s", "t", (F.length("t") - F.length("s")).cast("double").alias("d"), ((2 + share) / 3).alias("sim"), F.lit("start").alias("kind"))
    short = probes.join(_kept(_short_forms(vocabulary), "short"), ["rel", "s"]).select("rel", "s", "t", F.lit(1.0).alias("d"), F.lit(o.abbreviation).alias("sim"), F.lit("short").alias("kind"))
    known = written(fixes.select("rel", "s", "t", "d", "sim", F.lit("fix").alias("kind")).unionByName(cut).unionByName(short), "known")
    apart = merge_join(glued, known.where("kind = 'fix'").withColumnRenamed("s", "rest"), ["rel", "rest"]).select(known.columns)
    known = written(known.unionByName(apart), "known")

    # what a word of the list weighs where it stands beside an entry that lacks it
    weights = merge_join(known.where(f"kind = 'fix' AND sim >= {o.min_score}").join(vocabulary, ["rel", "t"]), beside, ["rel", "s"], "left")
    weights = weights.groupBy("rel", "s").agg(F.max(F.col("sim") * F.col("idf") * F.col("df") / (F.col("df") + F.coalesce("beside", F.lit(0)))).alias("weight"))
    heavy = written(singles.join(_kept(weights, "weights"), ["rel", "s"]).select("vid", "i", "weight"), "heavy")
    total = heavy.groupBy("vid").agg(F.sum("weight").alias("total"))

    # hits of values, and what of those weights each of them covers
    hits = parts.select("rel", "vid", "i", "j", "end", "s").join(small(known), ["rel", "s"]).where("kind <> 'start' OR end")  # what is cut off is the end of a value
    hits = written(hits.drop("end"), "hits")
    places = hits.select("vid", "i", "j").distinct().withColumn("at", F.explode(F.sequence("i", F.col("j") - 1)))
    covered = merge_join(places, heavy.withColumnRenamed("i", "at"), ["vid", "at"]).groupBy("vid", "i", "j").agg(F.sum("weight").alias("covers"))
    hits = merge_join(hits, covered, ["vid", "i", "j"], "left").withColumn("covers", F.coalesce("covers", F.lit(0.0)))

    by_token = hits.where("kind <> 'start'").join(vocabulary, ["rel", "t"])
    best = by_token.groupBy("rel", "vid", "t").agg(F.max_by(F.struct("sim", "d", "idf", "covers"), F.struct("sim", "covers", -F.col("i"))).alias("b"))
    votes = best.join(tokens, ["rel", "t"]).groupBy("rel", "vid", "entry_id").agg(F.sum(F.col("b.sim") * F.col("b.idf")).alias("got"), F.sum("b.covers").alias("covers"), F.count(F.lit(1)).alias("found"), F.sum("b.d").alias("d"))
    votes = votes.join(sums, ["rel", "entry_id"]).where("found = m").select("vid", "entry_id", "got", "covers", "d", "all_idf")
    spelt = hits.where("kind <> 'short'").join(_kept(wholes, "wholes"), ["rel", "t"]).join(sums, ["rel", "entry_id"])
    votes = votes.unionByName(spelt.select("vid", "entry_id", (F.col("sim") * F.col("all_idf")).alias("got"), "covers", "d", "all_idf"))

    extra = F.greatest(F.lit(0.0), F.coalesce("total", F.lit(0.0)) - F.col("covers"))
    scored = merge_join(votes, total, ["vid"], "left").withColumn("score", F.round((F.col("got") - extra) / F.col("all_idf"), 6)).where(F.col("score") >= o.min_score)
    chosen = scored.groupBy("vid").agg(F.max_by("entry_id", F.struct("score", -F.col("d"), -F.col("entry_id"))).alias("entry_id"))
    return merge_join(v, chosen, ["vid"], "left").select("rel", "value", F.coalesce("entry_id", F.lit(-1)).cast("bigint").alias("entry_id"))


def entries_found(examples: DataFrame, entries: DataFrame, o: Options = Options()) -> DataFrame:
    """(example_id, entry_id) of each example whose whole triplet has a listed relation and an object that is not an entry's exact name.

    Values are mapped once each, however many rows hold them, and the results go back to the rows with hot values sent by broadcast.
    Examples whose triplet is null, not whole or of another relation take no part; an empty table gives an empty result.
    """
    listed = entries.select("entry_id", core(F.col("relation")).alias("rel"), "entry_name")
    rows = examples.where(whole_triplet(F.col("triplet"))).select("example_id", core(F.col("triplet")[1]).alias("rel"), F.col("triplet")[2].alias("value"))
    rows = rows.join(_kept(listed.select("rel").distinct(), "relations"), "rel", "left_semi")
    rows = rows.join(_kept(listed.select("rel", F.col("entry_name").alias("value")), "names"), ["rel", "value"], "left_anti")
    counted = written(rows.groupBy("rel", "value").agg(F.count(F.lit(1)).alias("rows")), "typed")
    result = written(merge_join(counted, mapped(counted, listed, o), ["rel", "value"]), "mapped")
    total = counted.agg(F.sum("rows")).first()[0] or 0
    return even_join(rows, result, ["rel", "value"], "rows", total, cheap=True).select("example_id", "entry_id")
