"""Problem 7: a mix of sources in which each has its target share of the tokens.

Tokens are summed for each source; a source's repetition rate is its target number of tokens over the tokens it has, at most its cap. Each
document comes out floor(rate) times, and once more if a hash of its id and the seed falls below the rest of the rate. No document's fate
depends on another's, so nothing is shuffled but one sum for each source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.llm import tokens
from tripleloom.storage import small, written


@dataclass(frozen=True)
class Source:
    source: str
    target_share: float
    max_repeats: int
    available: int


def rates(sources: list[Source]) -> dict[str, float]:
    """The repetition rate of each source.

    The mix is to have as many tokens as the sources hold together. A source that its cap keeps below its target gives all it may; what is then
    missing is spread over the others in proportion to their targets, until all fit or all are at their caps.
    """
    total = sum(s.available for s in sources)
    open_ = {s.source: s for s in sources if s.available > 0 and s.target_share > 0}
    out = {s.source: 0.0 for s in sources}
    left = float(total)
    while open_:
        weight = sum(s.target_share for s in open_.values())
        full = [s for s in open_.values() if left * s.target_share / weight >= s.available * s.max_repeats]
        if not full:
            out |= {s.source: left * s.target_share / weight / s.available for s in open_.values()}
            break
        for s in full:
            out[s.source] = float(s.max_repeats)
            left -= s.available * s.max_repeats
            del open_[s.source]
    return out


def copies_of(rate: Column, key: Column, seed: int) -> Column:
    """How often a document comes out: floor(rate), and once more with the rest of the rate as probability."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


class Mix:
    """A mix of documents by targets (source, target_share, max_repeats; few rows, one for each source).

    Documents of other sources and of a null source take no part. Null and empty texts have no tokens but come out as often as others of their
    source. A source without tokens gets the rate 0. Repeated documents with ids of their own are documents of their own.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 7, folder: str = tokens.FOLDER, name: str = tokens.NAME):
        self.seed = seed
        self.documents = documents.join(small(targets.select("source")), "source", "left_semi")
        self.targets = targets
        self.sizes = written(tokens.counted(self.documents, ["doc_id", "source"], folder=folder, name=name), "sizes")
        sums = {r.source: r.n for r in self.sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        rows = [Source(r.source, r.target_share, r.max_repeats, sums.get(r.source, 0)) for r in targets.select("source", "target_share", "max_repeats").collect()]
        found = rates(rows)
        table = [(s.source, s.target_share, s.max_repeats, s.available, found[s.source]) for s in rows]
        self.rates = documents.sparkSession.createDataFrame(table, "source string, target_share double, max_repeats int, available_tokens bigint, rate double")

    def _copies(self, df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(self.rates.select("source", "rate")), "source").withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"), self.seed))

    def records(self) -> DataFrame:
        """(doc_id, source, copy_no, text): every copy of every document in the mix, copy_no from 1."""
        rows = self._copies(self.documents.select("doc_id", "source", "text")).where("copies > 0")
        return rows.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "text")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeats, available_tokens, rate, documents, mix_tokens, actual_share), one row for each target."""
        got = self._copies(self.sizes).groupBy("source").agg(F.sum("copies").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"))
        rows = self.rates.join(got, "source", "left").fillna(0, ["documents", "mix_tokens"])
        all_ = got.agg(F.sum("mix_tokens").alias("all_tokens"))
        share = F.when(F.col("all_tokens") > 0, F.col("mix_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0))
        return rows.join(F.broadcast(all_)).withColumn("actual_share", share).drop("all_tokens")
