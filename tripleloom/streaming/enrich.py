"""Growing a vocabulary on a stream of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripleloom.operators import canonicalize
from tripleloom.storage import shared_path


class Vocabulary:
    """A vocabulary in the shared folder, one version for each micro-batch; a batch that is run again writes its version again."""

    def __init__(self, schema: DataFrame, path: str | None = None):
        self.spark = schema.sparkSession
        self.path = path or shared_path(self.spark, "vocabulary")
        self.ddl = schema.select("ord", "relation", "definition", "origin", "embedding").schema
        schema.select(*self.ddl.names).write.mode("overwrite").parquet(f"{self.path}/version=-1")

    def at(self, version: int) -> DataFrame:
        return self.spark.read.schema(self.ddl).parquet(f"{self.path}/version={version}")

    def put(self, version: int, schema: DataFrame) -> None:
        schema.select(*self.ddl.names).write.mode("overwrite").parquet(f"{self.path}/version={version}")


def enrich_stream(triples: DataFrame, vocabulary: Vocabulary, embed, tau: float, target: str, checkpoint: str, unit: str = "document", available_now: bool = True) -> StreamingQuery:
    """Canonicalises a stream of triples (doc_ord, pos, s, p, o, definition) with a vocabulary that grows from micro-batch to micro-batch.

    Documents come whole within a micro-batch and micro-batches in order of doc_ord; the result then is that of one run over all. Each batch's
    triples are written under ``target`` by batch number, over those of an attempt that failed.
    """

    def step(batch: DataFrame, number: int) -> None:
        out, grown = canonicalize.enriched(batch, vocabulary.at(number - 1), embed, tau, unit)
        vocabulary.put(number, grown)
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = triples.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_seen(events: DataFrame, key: str, at: str, delay: str = "1 hour", window: str | None = None) -> DataFrame:
    """(key, first_at): when each value was first seen on a stream or in a table; with ``window`` once for each window of time, closed by a watermark."""
    if window is None:
        return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("first_at"))
    marked = events.withWatermark(at, delay).where(F.col(key).isNotNull())
    return marked.groupBy(F.window(at, window).alias("w"), key).agg(F.min(at).alias("first_at")).select(F.col("w.start").alias("window_start"), key, "first_at")
