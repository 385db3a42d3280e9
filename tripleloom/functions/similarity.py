"""Inner products of vectors, and the nearest of a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.storage import fits_broadcast

#: Bytes of the vocabulary's vectors, as doubles, that are scored at once; a larger vocabulary is taken in blocks of so many.
BLOCK_BYTES = 64 << 20
#: Scores that are held at once.
CELLS = 4_000_000
#: Decimals that scores are rounded to before they are ranked, so that the order of summation cannot decide.
DECIMALS = 6


def dot(a: Column, b: Column) -> Column:
    """The plain inner product of two arrays, summed as doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k best scores of each row, best first, ties by column."""
    n = scores.shape[1]
    if k < n // 4:  # without sorting all: whatever is as good as the k-th best, then the order among those
        bound = np.partition(scores, n - k, axis=1)[:, n - k, None]
        masked = np.where(scores >= bound, scores, -np.inf)
        return np.argsort(-masked, axis=1, kind="stable")[:, :k] if (masked > -np.inf).sum(1).max() > 4 * k else _few(masked, k)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _few(masked: np.ndarray, k: int) -> np.ndarray:
    """_best for rows of which few columns are left."""
    row, col = np.nonzero(masked > -np.inf)
    order = np.lexsort((col, -masked[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(masked)))
    return col[first[:, None] + np.arange(k)]


def _top(scores: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best scores of each row that are at least ``least``; columns come by ord, so ties keep that order."""
    order = _best(scores, k)
    row, at = np.nonzero(np.take_along_axis(scores, order, 1) >= least)
    return row, order[row, at]


def _raised(scores: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores of at least ``least`` that are above all before them in their row."""
    before = np.maximum.accumulate(scores, axis=1)[:, :-1]
    above = scores >= least
    above[:, 1:] &= scores[:, 1:] > before
    return np.nonzero(above)


def _scored(queries: DataFrame, keys: list[str], vector: str, ords: np.ndarray, matrix: np.ndarray, pick, k: int, least: float) -> DataFrame:
    """(keys, ord, score): what ``pick`` takes of one block of the vocabulary for each query, by a matrix product on each Arrow batch."""
    held = queries.sparkSession.sparkContext.broadcast((ords, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ords, matrix = held.value
        step = max(1, CELLS // len(ords))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                own = batch.column(batch.num_columns - 1)
                vectors = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                scores = np.round(vectors @ matrix.T, DECIMALS)
                row, col = pick(scores, k, least)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(ords[col]), pa.array(scores[row, col] + 0.0)], names=[*keys, "ord", "score"])

    fields = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in keys)
    return queries.select(*keys, vector).where(F.col(vector).isNotNull()).mapInArrow(run, f"{fields}, ord bigint, score double")


def blocks(vocabulary: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ords, matrix) of the vocabulary's vectors in order of ord, each block of at most BLOCK_BYTES; nothing for an empty vocabulary."""
    rows = vocabulary.where("embedding IS NOT NULL").select(F.col("ord").cast("bigint").alias("ord"), "embedding").orderBy("ord")
    first = rows.limit(1).toArrow()
    if not first.num_rows:
        return
    dims = len(first["embedding"][0])
    size, after = max(1, BLOCK_BYTES // (8 * max(1, dims))), None
    while True:
        block = (rows if after is None else rows.where(F.col("ord") > after)).limit(size).toArrow()
        if block.num_rows:
            ords = block["ord"].to_numpy()
            yield ords, block["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ords), -1)
            after = int(ords[-1])
        if block.num_rows < size:
            return


def nearest(queries: DataFrame, keys: list[str], vector: str, vocabulary: DataFrame, k: int, strategy: str = "matrix", least: float = float("-inf")) -> DataFrame:
    """(keys, rank, ord, score): the k vectors of a vocabulary with the largest inner product with each query, rank from 1.

    queries has ``keys``, together unique, and the array ``vector``; vocabulary has ``ord``, unique, and ``embedding``, all of one length.
    Scores are rounded before they are ranked; ties go to the smaller ord; scores below ``least`` are left out. Null vectors give no rows, an empty vocabulary an empty result.
    ``matrix`` multiplies blocks in NumPy and moves only the vocabulary; ``native`` scores with JVM expressions where the vocabulary is small
    enough to broadcast, an array of the k best for each query without a shuffle, and is ``matrix`` beyond that.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "ord")
    if strategy == "native" and fits_broadcast(vocabulary.select("ord", "embedding")):
        held = vocabulary.where("embedding IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("ord", "embedding"))).alias("_v"))
        scored = F.transform("_v", lambda v: F.struct((-(F.round(dot(F.col("_q"), v["embedding"]), DECIMALS) + 0.0)).alias("low"), v["ord"].alias("ord")))
        best = F.slice(F.array_sort(F.filter(scored, lambda x: -x["low"] >= least)), 1, k)
        each = queries.select(*keys, F.col(vector).alias("_q")).where("_q IS NOT NULL").join(F.broadcast(held))
        return each.select(*keys, F.posexplode(best).alias("at", "x")).select(*keys, (F.col("at") + 1).alias("rank"), "x.ord", (0.0 - F.col("x.low")).alias("score"))
    found = _in_blocks(queries, keys, vector, vocabulary, _top, k, least)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*keys, "rank", "ord", "score")


def _in_blocks(queries: DataFrame, keys: list[str], vector: str, vocabulary: DataFrame, pick, k: int, least: float) -> DataFrame:
    found = None
    for ords, matrix in blocks(vocabulary):
        part = _scored(queries, keys, vector, ords, matrix, pick, k, least)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else queries.select(*keys, F.lit(0).cast("bigint").alias("ord"), F.lit(0.0).alias("score")).limit(0)


def rising(queries: DataFrame, keys: list[str], vector: str, vocabulary: DataFrame, least: float) -> DataFrame:
    """(keys, ord, score): of the vocabulary in order of ord the vectors whose score with a query is at least ``least`` and above all before.

    The last of them up to any ord is the best of the vocabulary up to there, ties to the smaller ord. There are few for each query: of a
    vocabulary in chance order as many as its size has digits in base e. Null vectors give no rows.
    """
    found = _in_blocks(queries, keys, vector, vocabulary, _raised, 0, least)
    before = F.max("score").over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_before", before).where("_before IS NULL OR score > _before").drop("_before")


def near(queries: DataFrame, keys: list[str], vector: str, vocabulary: DataFrame, least: float) -> DataFrame:
    """(keys) of the queries that some vector of the vocabulary scores at least ``least`` with; a query may come once for each block."""
    return _in_blocks(queries, keys, vector, vocabulary, _top, 1, least).select(*keys)
