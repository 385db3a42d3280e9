"""Tables, the shared folder, and joins that stay even when one key is hot."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side may be broadcast when it has at most this many rows, and its values take at most this many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: Rows of one key that a single task may join; keys with more go by broadcast.
GROUP_ROWS = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def known_to_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder it was imported from, wherever they are started."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs on this machine alone is a folder made here; on a cluster that is an error, as each machine would
    write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tripleloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths in the shared folder that this process has given out and not yet deleted.
_PATHS: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _PATHS[-1]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _PATHS:
        _PATHS.remove(path)


def delete_tables(spark: SparkSession) -> None:
    """Deletes all that this process wrote to the shared folder: for the end of a job, once its results have been read or written elsewhere."""
    for path in list(_PATHS):
        delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(24) + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(24), lambda s, x: s + _bytes(x, kind.elementType)), F.lit(24))
        return F.lit(24) + 8 * F.greatest(F.size(c), F.lit(0))
    if isinstance(kind, T.MapType):
        return _bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _bytes(F.map_values(c), T.ArrayType(kind.valueType))
    return F.lit(16)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most ``rows`` rows that take at most ``size`` bytes; reads no more than one row beyond that.

    The bytes are those of the values, not of the files they come from.
    """
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    n, total = df.select(width.cast("bigint").alias("_w")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    return n <= rows and total <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """df with a broadcast hint if it is small by rows and bytes; else with a merge hint, so that no estimate from compressed files makes it broadcast.

    ``of`` names a table that df is a part of, which is measured once: where it is small as a whole, its parts are.
    """
    if of is not None:
        if not hasattr(of, "_is_small"):
            of._is_small = fits_broadcast(of)
        if of._is_small:
            return F.broadcast(df)
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df.hint("merge")


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the data: always by shuffle and sort, whatever Spark guesses their sizes to be.

    Spark sizes a side by the compressed files it comes from, even where a few bytes there become a hundred rows; such a side must not be
    broadcast. Keys that many rows of one side share are split at run time by adaptive execution.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def even_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", share: float = 0.001, cheap: bool = False) -> DataFrame:
    """Join many-to-one on ``keys`` where single keys may hold a third of left.

    right has one row for each key, with ``weight``, the number of rows of left that have it; total is the sum of the weights. Keys of
    more than ``share`` of all rows or of GROUP_ROWS rows, whichever is less, go by broadcast, as far as their bytes allow; all other keys by a
    shuffled join whose groups are bounded by that. With ``cheap``, where right is read from a table, all of it goes by broadcast if it is small.
    The weight column is dropped. Null keys match nothing.
    """
    limit = min(GROUP_ROWS, max(1, int(total * share)))
    if cheap and fits_broadcast(right):
        return left.join(F.broadcast(right.drop(weight)), keys, how)
    hot = F.col(weight) > limit
    heavy = right.where(hot).drop(weight)
    if not fits_broadcast(heavy):  # many wide keys: adaptive execution splits those that turn out to be hot
        return merge_join(left, right.drop(weight), keys, how)
    light = merge_join(left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti"), right.where(~hot).drop(weight), keys, how)
    return left.join(F.broadcast(heavy), keys, "inner").unionByName(light)
