"""Problem 5: how often every term occurs, kept up to date by signed changes.

A change is a set of records with a sign: +1 for a record that was added, -1 for one that was deleted; a changed record is its old form with
-1 and its new form with +1. Only the records of a change are read. Their per-term sums are merged into counts that live in a partitioned
table, whose number of partitions doubles as it grows. A merge writes the partitions it touches anew, under names of their own, and then a
manifest that names the folder of every partition. A manifest is created once and never written over: a job that dies in the middle leaves the
old version whole, of two jobs that start from the same version one fails, and a change that carries an id is merged once however often it is
tried.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.text import words

_COUNTS = "term string, occurrences bigint, examples bigint"
#: Terms that a partition of the counts holds on average at most; beyond, their number doubles.
TERMS = 500_000


def term_delta(records: DataFrame, column: str = "triplet", sign: str | None = None) -> DataFrame:
    """(term, occurrences, examples): the signed sums of the records of a change.

    ``column`` is an array of strings; ``sign`` names a column of +1 and -1, without it every record is an addition. Records with the same
    array are summed before they are cut into words. Null arrays, null elements and elements without words add nothing. A record counts once
    for each of its terms, however often the term occurs in it.
    """
    weight = F.col(sign).cast("bigint") if sign else F.lit(1).cast("bigint")
    same = records.where(F.size(column) > 0).groupBy(F.col(column).alias("value")).agg(F.sum(weight).alias("w")).where("w <> 0")
    every = same.select("w", F.flatten(F.transform(F.filter("value", lambda x: x.isNotNull()), words)).alias("ws"))
    once = F.transform(F.array_distinct("ws"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("o"), F.lit(1).alias("e")))
    each = F.transform("ws", lambda t: F.struct(t.alias("term"), F.lit(1).alias("o"), F.lit(0).alias("e")))
    hits = every.select("w", F.inline(F.concat(each, once)))
    return hits.groupBy("term").agg(F.sum(F.col("o") * F.col("w")).alias("occurrences"), F.sum(F.col("e") * F.col("w")).alias("examples")).where("occurrences <> 0 OR examples <> 0")


class TermCounts:
    """Persistent counts under ``path``, partitioned by hash of the term; ``terms`` is the average number of terms beyond which partitions double."""

    def __init__(self, spark: SparkSession, path: str, terms: int = TERMS):
        self.spark, self.path, self.terms = spark, path.rstrip("/"), terms
        self.load()

    def _at(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def load(self) -> None:
        """Takes up the last version that was written."""
        found = {int(x.split("-")[0]): x for x in self._names(f"{self.path}/manifest")}
        self.changes = {x.split("-", 1)[1] for x in found.values()} - {""}
        self.version, self.buckets, self.records, self.folders = 0, 1, 0, {}
        if found:
            self.version = max(found)
            now = json.loads(self.spark.read.text(f"{self.path}/manifest/{found[self.version]}", wholetext=True).first().value)
            self.buckets, self.records, self.folders = now["buckets"], now["records"], {int(b): x for b, x in now["folders"].items()}

    def _commit(self, change: str) -> None:
        """Makes the next version stand; fails if another job has made one of that number."""
        number = self.version + 1
        if any(x.startswith(f"{number}-") for x in self._names(f"{self.path}/manifest")):
            raise RuntimeError(f"version {number} was written by another job: load and merge again")
        fs, claim = self._at(f"{self.path}/claims/{number}")
        try:
            fs.create(claim, False).close()  # of two jobs one gets this file
        except Py4JJavaError as e:
            raise RuntimeError(f"version {number} is being written by another job; if that job has died, delete {claim}") from e
        fs, draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps({"buckets": self.buckets, "records": self.records, "folders": self.folders}).encode())
        out.close()
        _, last = self._at(f"{self.path}/manifest/{number}-{change}")
        fs.mkdirs(last.getParent())
        if not fs.rename(draft, last):
            raise RuntimeError(f"version {number} could not be written")
        self.version = number

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")

    def _read(self, buckets: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/counts/{x}/bucket={b}" for b, x in sorted(self.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(_COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], _COUNTS)

    def _write(self, rows: DataFrame, buckets: int) -> dict[int, str]:
        """Writes rows by partition under a new name; partition -> name."""
        name = f"{self.version + 1}-{uuid.uuid4().hex[:8]}"
        parted = rows.select("term", "occurrences", "examples", self._bucket(buckets).alias("bucket"))
        (parted.repartition(buckets, "bucket") if buckets > 1 else parted.coalesce(1)).write.partitionBy("bucket").parquet(f"{self.path}/counts/{name}")
        return {int(x.split("=")[1]): name for x in self._names(f"{self.path}/counts/{name}") if x.startswith("bucket=")}

    def merge(self, delta: DataFrame, records: int, change: str = "") -> bool:
        """Add the signed sums of a change, and the signed number of its records (those without terms included); False if it was merged before.

        Terms that fall to zero disappear. Partitions that no term of the change falls in are left as they are. ``change`` is an id fit for a
        file's name; without one nothing is known of earlier tries.
        """
        if change and change in self.changes:
            return False
        if self.folders:
            staged = f"{self.path}/staged/{uuid.uuid4().hex}"
            delta.select("term", "occurrences", "examples").write.parquet(staged)
            new = self.spark.read.schema(_COUNTS).parquet(staged)
            size = new.count() + self._read().count()
        else:
            new, staged = delta.select("term", "occurrences", "examples").persist(), None
            size = new.count()
        buckets = self.buckets
        while size > buckets * self.terms:
            buckets *= 2
        touched = {r.b for r in new.select(self._bucket(buckets).alias("b")).distinct().collect()} if buckets == self.buckets else set(range(buckets))
        if touched and size:
            old = self._read({b % self.buckets for b in touched}) if self.folders else None
            both = new if old is None else old.unionByName(new).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("examples").alias("examples")).where("occurrences <> 0 OR examples <> 0")
            now = self._write(both, buckets)
            self.folders = {b: x for b, x in self.folders.items() if b not in touched and buckets == self.buckets} | now
        if staged:
            fs, where = self._at(staged)
            fs.delete(where, True)
        else:
            new.unpersist()
        self.buckets, self.records = buckets, self.records + records
        self._commit(change)
        self.changes |= {change} - {""}
        return True

    def apply(self, records: DataFrame, column: str = "triplet", sign: str | None = None, change: str = "") -> bool:
        """Merge the change that a set of records with signs is; False if a change of this id was merged before."""
        if change and change in self.changes:
            return False
        number = records.agg(F.sum(F.col(sign).cast("bigint")) if sign else F.count(F.lit(1))).first()[0] or 0
        return self.merge(term_delta(records, column, sign), number, change)

    def counts(self) -> DataFrame:
        """(term, occurrences, examples) of every term that now occurs."""
        return self._read()

    def marked(self, rare_below: int = 3, common_above: float = 0.05) -> DataFrame:
        """counts with ``mark``: rare if fewer than ``rare_below`` records hold the term, else common if more than the share
        ``common_above`` of all records do, else null. With few records a term may meet both; it is rare then."""
        n = F.col("examples")
        return self.counts().withColumn("mark", F.when(n < rare_below, "rare").when(n > F.lit(common_above) * F.lit(self.records), "common"))
