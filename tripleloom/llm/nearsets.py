"""Problem 3: summaries that share most of their words, found exactly and without comparing all with all.

Universe-partition pigeonhole. Profiles with the same set of words are one class, and only classes are compared. Classes fall into bands by
the size of their set; two similar sets are in the same or in neighbouring bands. For a band the universe of words is cut by hash into
segments. Two sets that differ in at most H words can differ in few segments only: if a set is looked up by whole segments (cost 1 of the
budget H + 1) and by segments up to one word (cost 2), and the costs of the chosen segments sum to H + 1, no similar set is missed. Which
segments are looked up in which way is chosen for each set by how many sets share them, known from a count sketch over all rows, so segments
of common words are left out wherever the budget allows. What meets in a segment is verified on the whole sets.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripleloom.functions import strict_json
from tripleloom.storage import delete, even_join, merge_join, small, written

#: Least and most cells of the count sketch. Between them it has four for each set; beyond, costs are told apart less finely, results stay exact.
SKETCH = (1 << 20, 1 << 24)
#: Members of a class that are paired at once.
BLOCK = 1000

#: A longest run of letters and digits: what \w holds but the underscore.
_WORDS = re.compile(r"[^\W_]+").findall
#: For texts of ASCII alone: all but letters and digits become blanks.
_BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}


def _word_set(text: str | None) -> str | None:
    if text is None:
        return None
    return " ".join(sorted(set(text.lower().translate(_BLANKS).split()) if text.isascii() else {x.lower() for x in _WORDS(text)}))


@F.pandas_udf(T.StringType())
def summary_words(profiles: pd.Series) -> pd.Series:
    """The distinct words of the readable summary of a profile, sorted, with blanks between; null if there is none."""
    return profiles.map(lambda x: _word_set(strict_json.summarization(x)))


class Bands:
    """Bands of set sizes for a least similarity, and the number of segments of each."""

    def __init__(self, similarity: float, least: int):
        self.t, self.least = similarity, max(1, least)

    def low(self, band: int) -> int:
        """The smallest size in a band."""
        return math.ceil(self.least / self.t**band - 1e-9)

    def of_all(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size."""
        lows = [self.low(0)]
        while lows[-1] <= sizes.max():
            lows.append(self.low(len(lows)))
        return np.searchsorted(np.array(lows), sizes, side="right") - 1

    def tops(self, band: np.ndarray) -> np.ndarray:
        """The largest size in each band."""
        return np.array([self.low(b + 1) - 1 for b in range(int(band.max()) + 1)])[band]

    def differ_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most words in which sets of these sizes may differ and still be similar."""
        return ((1 - self.t) / (1 + self.t) * (a + b) + 1e-9).astype(np.int64)

    def segment_table(self, sizes: np.ndarray) -> np.ndarray:
        """The number of segments of every band up to that of the largest size: half the words that sets may differ in, so that few, large
        segments looked up to one word do, which few unlike sets share."""
        out = []
        for band in range(int(self.of_all(sizes).max()) + 1):
            top = self.low(band + 1) - 1
            need = int(self.differ_all(np.array(top), np.array(int(top / self.t + 1e-9)))) + 1
            out.append(max(2, (need + 1) // 2))
        return np.array(out)


def _mixed(total: np.ndarray, band: np.ndarray, segment: np.ndarray, kind: int) -> np.ndarray:
    """64-bit keys of the parts of sets that lie in segments, from the sums of the words' hashes; kind tells whole parts (0) from parts short of a word (1)."""
    x = total + (band.astype(np.uint64) * np.uint64(1 << 20) + segment.astype(np.uint64) * np.uint64(2) + np.uint64(kind + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Layout:
    """The sets of a batch cut into the segments of one band each: a slot for every segment of every set, word by word in ``slot``."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, band: np.ndarray, segments: np.ndarray):
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.count = segments[band]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        part = ((hashes >> np.uint64(32)) % self.count[self.row].astype(np.uint64)).astype(np.int64)
        self.slot = self.first[self.row] + part
        total = np.zeros(self.first[-1], np.uint64)
        np.add.at(total, self.slot, hashes)
        self.owner = np.repeat(np.arange(len(sizes)), self.count)
        segment = np.arange(self.first[-1]) - self.first[self.owner]
        less = total[self.slot] - hashes
        self.whole = [_mixed(total, band[self.owner], segment, kind) for kind in (0, 1)]
        self.less = [_mixed(less, band[self.row], part, kind) for kind in (0, 1)]


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, sizes of the sets) of a batch (id, hs)."""
    lists = batch.column(1)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _marks(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits for each set, each the parity of how many of its words fall on it: the bits in which two sets differ are at most the words in which they do."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), starts).view(np.int64)


def _levels(one: list[float], both: list[float], need: int) -> list[int]:
    """How each segment is looked up, 0 not, 1 whole, 2 up to one word, at little cost so that the levels sum to ``need``.

    one and both are the costs of level 1 and 2. Steps are taken by least cost for each unit gained; two units at once where that is cheaper.
    """
    level = [0] * len(one)
    heap = [(c, i, 1) if c <= b / 2 else (b / 2, i, 2) for i, (c, b) in enumerate(zip(one, both))]
    heapq.heapify(heap)
    got = 0
    while got < need and heap:
        _, i, to = heapq.heappop(heap)
        got += to - level[i]
        level[i] = to
        if to == 1:
            heapq.heappush(heap, (both[i] - one[i], i, 2))
    assert got >= need, "too few segments for the budget"
    return level


def _sketched(sets: DataFrame, bands: Bands, size: int) -> np.ndarray:
    """About how many sets are stored under the keys of each of ``size`` cells, less what a cell has by chance; over all sets."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            hashes, sizes = _batch(batch)
            if len(sizes):
                cut = _Layout(hashes, sizes, bands.of_all(sizes), bands.segment_table(sizes))
                counts += np.bincount((np.concatenate([cut.whole[0], cut.less[1]]) % np.uint64(size)).astype(np.int64), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "n"])

    rows = sets.mapInArrow(cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").cast("float").alias("n")).toArrow()
    sketch = np.zeros(size, np.float32)
    sketch[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return np.maximum(sketch - np.median(sketch), 0)


def similar_sets(sets: DataFrame, similarity: float = 0.75, least: int = 8) -> DataFrame:
    """(a, b, common, united): all pairs of sets, a the smaller id, whose common words are at least ``similarity`` of their words together.

    sets has ``id`` and ``ws``, distinct sets of at least ``least`` distinct words. Exact: candidates are complete by the pigeonhole argument
    above; of those that meet in a segment the ones that bit marks show to differ in too many words are dropped where they meet, the others are
    verified on the words themselves. An empty table gives an empty result.
    """
    bands = Bands(similarity, least)
    hashed = sets.select("id", F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))
    cells = 1 << min(max(4 * sets.count(), SKETCH[0]), SKETCH[1]).bit_length() - 1
    sketch = sets.sparkSession.sparkContext.broadcast(_sketched(hashed, bands, cells))

    def rows_of(ids: pa.Array, own: np.ndarray, keys: np.ndarray, sizes: np.ndarray, marks: np.ndarray, names: list[str]) -> pa.RecordBatch:
        columns = [pa.array(keys.view(np.int64)), ids.take(pa.array(own)), pa.array(sizes[own].astype(np.int32)), pa.array(marks[own])]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = _batch(batch)
            if len(sizes):
                cut = _Layout(hashes, sizes, bands.of_all(sizes), bands.segment_table(sizes))
                yield rows_of(batch.column(0), np.concatenate([cut.owner, cut.row]), np.concatenate([cut.whole[0], cut.less[1]]), sizes, _marks(hashes, sizes), ["key", "a", "na", "ma"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        cost = lambda keys: counts[(keys % np.uint64(cells)).astype(np.int64)] + np.float32(1)
        for batch in batches:
            hashes, sizes = _batch(batch)
            if not len(sizes):
                continue
            marks, own = _marks(hashes, sizes), bands.of_all(sizes)
            for down in (0, 1):
                band = own - down
                other = np.minimum(sizes, bands.tops(np.maximum(band, 0)))
                takes = (band >= 0) & (other >= similarity * sizes - 1e-9)
                if not takes.any():
                    continue
                words = takes[np.repeat(np.arange(len(sizes)), sizes)]
                at = np.flatnonzero(takes)
                cut = _Layout(hashes[words], sizes[at], band[at], bands.segment_table(sizes))
                one = cost(cut.whole[0])
                both = one + cost(cut.whole[1]) + np.bincount(cut.slot, cost(cut.less[0]), minlength=len(one)).astype(np.float32)
                need = bands.differ_all(sizes[at], other[at]) + 1
                one_, both_, first = one.tolist(), both.tolist(), cut.first.tolist()
                level = np.array([x for k, n in enumerate(need.tolist()) for x in _levels(one_[first[k] : first[k + 1]], both_[first[k] : first[k + 1]], n)])
                fewer, more = level >= 1, level == 2
                word = more[cut.slot]
                keys = np.concatenate([cut.whole[0][fewer], cut.whole[1][more], cut.less[0][word]])
                who = at[np.concatenate([cut.owner[fewer], cut.owner[more], cut.row[word]])]
                yield rows_of(batch.column(0), who, keys, sizes, marks, ["key", "b", "nb", "mb"])

    kept = hashed.mapInArrow(stored, "key bigint, a bigint, na int, ma bigint")
    looked = hashed.mapInArrow(asked, "key bigint, b bigint, nb int, mb bigint")
    fits = (F.col("na") >= F.lit(similarity) * F.col("nb") - 1e-9) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    differ = F.bit_count(F.col("ma").bitwiseXOR(F.col("mb")))
    close = differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("na") + F.col("nb")) + 1e-9
    pairs = merge_join(kept, looked, "key").where(fits & close).select("a", "b").distinct()
    first = sets.select(F.col("id").alias("a"), F.col("ws").alias("wa"))
    second = sets.select(F.col("id").alias("b"), F.col("ws").alias("wb"))
    both = merge_join(merge_join(pairs, first, "a"), second, "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
    both = both.withColumn("united", F.size("wa") + F.size("wb") - F.col("common")).where(F.col("common") >= F.lit(similarity) * F.col("united") - 1e-9)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", "united")


def profile_sets(profiles: DataFrame, least: int = 8) -> DataFrame:
    """(doc_ord, ws) of the profiles that take part: those with a readable summary of at least ``least`` distinct words, which ws holds as one text."""
    return profiles.select("doc_ord", summary_words("business_summary").alias("ws")).where(F.size(F.split("ws", " ")) >= least).where("ws <> ''")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_ord, id, n), (id, ws)): each profile with the class of equal sets it is in, named by its smallest doc_ord, and the class's number of profiles; each class's set."""
    rows = written(sets, "sets")
    reps = written(rows.groupBy("ws").agg(F.min("doc_ord").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    many = reps.where("n > 1").select("ws", "id", "n", F.col("n").alias("_n"))
    total = reps.agg(F.sum("n")).first()[0] or 0
    members = even_join(rows, many, ["ws"], "_n", total, cheap=True).select("doc_ord", "id", "n").unionByName(reps.where("n = 1").select(F.col("id").alias("doc_ord"), "id", "n"))
    return written(members, "members"), reps.select("id", F.split("ws", " ").alias("ws"), "n")


def near_profiles(profiles: DataFrame, similarity: float = 0.75, least: int = 8) -> DataFrame:
    """(doc_ord_a, doc_ord_b), smaller first: all pairs of profiles that are similar, equal sets included.

    Profiles that are null, cut off, without the key or with fewer than ``least`` distinct words take no part. Classes are spread out block by
    block of their members, so that a class of a third of all profiles is many small groups.
    """
    members, reps = classes(profile_sets(profiles, least))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    every = reps.select("id", blocks(F.col("n")).alias("k"))
    pairs = similar_sets(reps, similarity, least).select("a", "b").unionByName(reps.where("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b")))
    wide = small(every.where("k > 1"))  # classes of more than a block
    pairs = pairs.join(wide.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a", "left").join(wide.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b", "left")
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.coalesce(k, F.lit(1)) - 1))
    pairs = pairs.select("a", "b", "kb", upto(F.col("ka")).alias("ia")).select("a", "b", "ia", upto(F.col("kb")).alias("ib"))
    placed = members.select("id", "doc_ord", F.pmod(F.xxhash64("doc_ord"), blocks(F.col("n"))).cast("int").alias("i"))
    left = placed.select(F.col("id").alias("a"), F.col("i").alias("ia"), F.col("doc_ord").alias("x"))
    right = placed.select(F.col("id").alias("b"), F.col("i").alias("ib"), F.col("doc_ord").alias("y"))
    rows = merge_join(merge_join(pairs, left, ["a", "ia"]), right, ["b", "ib"]).where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return rows.select(F.least("x", "y").alias("doc_ord_a"), F.greatest("x", "y").alias("doc_ord_b"))


def linked_profiles(profiles: DataFrame, similarity: float = 0.75, least: int = 8) -> DataFrame:
    """(doc_ord, class_id, links): each profile that takes part, with its class of equal sets and the number of other profiles it is similar to.

    The form for large collections: it says all that the pairs say, but copies are never spread out into pairs.
    """
    members, reps = classes(profile_sets(profiles, least))
    found = similar_sets(reps, similarity, least).select("a", "b")
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = merge_join(ends, reps.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("near"))
    links = merge_join(reps.select("id"), near, "id", "left").select("id", F.coalesce("near", F.lit(0)).alias("near"))
    rows = even_join(members, merge_join(links, reps.select("id", F.col("n").alias("_n")), "id"), ["id"], "_n", members.count())
    return rows.select("doc_ord", F.col("id").alias("class_id"), (F.col("n") - 1 + F.col("near")).alias("links"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group): the smallest id that each node is connected with.

    Large-star and small-star rounds by turns until nothing changes; both shrink the paths, so the number of rounds grows with the logarithm
    of a component's diameter. Each round is written to the shared folder, over which the round before is deleted; nothing but two sums comes
    to the driver. A round has changed nothing when the edges' number and the sum of their hashes stay.
    """
    spark = nodes.sparkSession
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = merge_join(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v"), "edges")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        step = merge_join(down, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(step.where("u <> v").distinct(), "edges")
        for old in (now, large):
            for path in old.inputFiles()[:1]:
                delete(spark, path.rsplit("/", 1)[0])
        now, same = after, state(after) == before
        before = state(after) if not same else before
        if same:
            break
    low = now.select(F.col("u").alias("id"), F.col("v").alias("low")).groupBy("id").agg(F.min("low").alias("low"))
    return merge_join(nodes.select("id"), low, "id", "left").select("id", F.coalesce("low", F.col("id")).alias("group"))


def profile_groups(profiles: DataFrame, similarity: float = 0.75, least: int = 8) -> DataFrame:
    """(doc_ord, group): every profile with the group of similar ones it is in, named by the smallest doc_ord; alone, its own.

    Profiles that take no part in the comparison come out too, each as its own group.
    """
    members, reps = classes(profile_sets(profiles, least))
    found = components(reps, similar_sets(reps, similarity, least))
    sized = merge_join(found, reps.select("id", F.col("n").alias("_n")), "id")
    inside = even_join(members, sized, ["id"], "_n", members.count()).select("doc_ord", "group")
    return merge_join(profiles.select("doc_ord"), inside, "doc_ord", "left").select("doc_ord", F.coalesce("group", "doc_ord").alias("group"))
