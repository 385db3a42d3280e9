"""Bringing the relations of triples to a vocabulary, which stays as it is or grows on the way.

A triple takes one of three paths: ``exact``, its relation is in the vocabulary; ``nodef``, it has no definition, or the vocabulary is empty;
``verify``, the nearest relations of the vocabulary are put before a verifier. What is verified is each distinct (relation, definition), not
each triple.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.functions.similarity import DECIMALS, near, nearest, rising
from tripleloom.storage import merge_join, shared_path, small, written

#: Pairs that are folded in order at first, and scored at once while they are.
CHUNK, FOLDED = 20_000, 1000

#: (candidates with relation, definition, score) -> the chosen candidate or null
Verifier = Callable[[Column], Column]


def threshold(tau: float) -> Verifier:
    """Accepts the best candidate from a score on."""
    return lambda candidates: F.when(F.try_element_at(candidates, F.lit(1))["score"] >= tau, F.try_element_at(candidates, F.lit(1)))


def paths(triples: DataFrame, schema: DataFrame) -> DataFrame:
    """Triples (with ``p`` and ``definition``) with their ``path``. A null relation is ``nodef``."""
    marked = triples.join(small(schema.select(F.col("relation").alias("p"), F.lit(True).alias("_known")), of=schema), "p", "left")
    return marked.withColumn("path", F.when(F.col("_known"), "exact").when(F.col("definition").isNull() | F.col("p").isNull(), "nodef").otherwise("verify")).drop("_known")


def candidates(queries: DataFrame, keys: list[str], vector: str, schema: DataFrame, k: int = 5, strategy: str = "matrix") -> DataFrame:
    """(keys, candidates): the k nearest relations of each query, best first, as an array of (relation, definition, score)."""
    top = nearest(queries, keys, vector, schema.select("ord", "embedding"), k, strategy)
    named = top.join(small(schema.select("ord", F.struct("relation", "definition").alias("_named")), of=schema), "ord")
    gathered = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "_named.relation", "_named.definition", "score"))).alias("c"))
    return gathered.select(*keys, F.transform("c", lambda c: F.struct(c["relation"].alias("relation"), c["definition"].alias("definition"), c["score"].alias("score"))).alias("candidates"))


def closed(triples: DataFrame, schema: DataFrame, embed: Callable[[DataFrame, str], DataFrame], verify: Verifier, k: int = 5, strategy: str = "matrix") -> DataFrame:
    """Triples with ``path``, ``candidates`` and ``canon``, the relation of the vocabulary or null.

    triples has (doc_ord, pos, s, p, o, definition); schema has (ord, relation, definition, embedding), relations unique; ``embed`` gives a
    table with a text column a column ``vector``. Exact triples keep their relation, those without a definition and those that the verifier
    refuses have a null ``canon``; an empty vocabulary refuses all. Repeated triples stay.
    """
    marked = paths(triples, schema)
    asked = embed(marked.where("path = 'verify'").select("definition").distinct(), "definition")
    found = candidates(asked, ["definition"], "vector", schema, k, strategy)
    verdict = found.withColumn("_chosen", verify(F.col("candidates"))["relation"])
    out = marked.join(verdict, "definition", "left")
    canon = F.when(F.col("path") == "exact", F.col("p")).when(F.col("path") == "verify", F.col("_chosen"))
    return out.withColumn("canon", canon).withColumn("candidates", F.when(F.col("path") == "verify", F.col("candidates"))).drop("_chosen")


# Growth. When a relation is refused it joins the vocabulary, so what a triple sees depends on all before it. But more vocabulary only ever raises
# a best score: a (relation, definition) that is accepted once is accepted ever after, and one that is refused is in the vocabulary ever after. So
# the vocabulary's history follows from the first appearance of each distinct pair, a table as small as a vocabulary, and that alone is folded in
# order. Given the history, all triples are resolved in parallel: what a pair saw at a time is the best among the relations that were there.


def _fold(unit: str, tau: float):
    """The ordered fold over frames of pairs that the vocabulary so far refuses: what joins it.

    A block of pairs is scored at once against what had joined before it, and within itself; only the verdicts are taken one by one.
    """

    folded = FOLDED

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, held = set(), []  # held: vectors that are seen, a matrix for each block
        dims = 0
        waiting, named, now = [], set(), None  # of the unit at hand: (block, row) of its new relations, and their names
        for frame in frames:
            for start in range(0, len(frame), folded):
                part = frame.iloc[start : start + folded]
                has = part["vector"].notna().to_numpy()
                dims = len(part["vector"].iloc[int(has.argmax())]) if has.any() else dims  # a block without vectors has the width of those before
                block = np.zeros((len(part), dims))
                if has.any():
                    block[has] = np.stack(part["vector"][has].to_list())
                old = np.zeros(len(part), bool)
                for m in held:
                    old |= np.round((block @ m.T).max(1), DECIMALS) >= tau
                inner = np.round(block @ block.T, DECIMALS) >= tau
                joined, new, carried = [], [], waiting
                waiting = []
                late = None if not carried else np.stack(carried)
                late_near = np.zeros(len(part), bool) if late is None else np.round((block @ late.T).max(1), DECIMALS) >= tau
                late_seen = False
                for i, (relation, doc, pos) in enumerate(zip(part["relation"], part["doc_ord"], part["pos"])):
                    place = {"triple": (doc, pos), "document": doc, "all": 0}[unit]
                    if place != now:
                        seen |= named
                        joined += waiting
                        late_seen = True
                        waiting, named, now = [], set(), place
                    if relation in seen or relation in named:
                        continue
                    if has[i] and (old[i] or (late_seen and late_near[i]) or (joined and inner[i, joined].any())):
                        continue
                    named.add(relation)
                    new.append(i)
                    if has[i]:
                        waiting.append(i)
                if late is not None and late_seen:
                    held.append(late)
                if joined:
                    held.append(block[joined])
                waiting = [*([] if late is None or late_seen else carried), *(block[i] for i in waiting)]
                yield part.iloc[new]

    return fold


def growth(pairs: DataFrame, schema: DataFrame, tau: float, unit: str = "document") -> DataFrame:
    """(relation, definition, vector, doc_ord, pos): the relations that join the vocabulary, at the triple that brings each.

    pairs has (relation, definition, vector, doc_ord, pos), each distinct pair once with the place of its first triple; a null vector stands
    for no definition. ``unit`` says from when on a new relation is seen: the next triple, the next document, or never (all). Pairs that the
    vocabulary accepts are set aside in parallel; the first of the others are folded in order, by one task; those after them are set aside in
    parallel again where they are near to what joined, and so on with twice as many. So only pairs that are like none before them wait for
    one another.
    """
    columns = ["relation", "definition", "vector", "doc_ord", "pos"]
    ddl = "relation string, definition string, vector array<float>, doc_ord bigint, pos int"
    rest, against, many, done = pairs.select(columns), schema.select("relation", "ord", "embedding"), CHUNK, None
    at = {"triple": F.struct("doc_ord", "pos"), "document": F.struct("doc_ord"), "all": F.struct(F.lit(0).alias("doc_ord"))}[unit]
    while True:
        left = rest.join(small(against.select("relation")), "relation", "left_anti")
        if not (done is not None and unit == "all"):
            taken = near(left.select("definition", "vector").dropDuplicates(["definition"]), ["definition"], "vector", against.select("ord", "embedding"), tau).distinct()
            left = merge_join(left, taken, "definition", "left_anti")
        rest = written(left.select(columns), "waiting")
        last = rest.select(at.alias("at")).orderBy("at").limit(many).agg(F.max("at"), F.count(F.lit(1))).first()
        if not last[1]:
            break
        whole = last[1] < many or unit == "all"
        end = F.lit(True) if whole else at <= F.struct(*[F.lit(x).cast(rest.schema[f].dataType).alias(f) for f, x in last[0].asDict().items()])
        ordered = rest.where(end).coalesce(1).sortWithinPartitions("doc_ord", "pos")
        new = written(ordered.mapInPandas(_fold(unit, tau), ddl), "joined")
        done = new if done is None else done.unionByName(new)
        if whole:
            break
        rest, many = rest.where(~end), 2 * many
        against = new.select("relation", F.monotonically_increasing_id().alias("ord"), F.col("vector").alias("embedding"))
    return done if done is not None else pairs.select(columns).limit(0)


def enriched(triples: DataFrame, schema: DataFrame, embed: Callable[[DataFrame, str], DataFrame], tau: float, unit: str = "document", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(triples, schema): closed canonicalisation with a vocabulary that takes in what it refuses.

    A triple's relation is kept if the vocabulary has it by then; else it becomes the nearest relation seen by then, from the score tau on;
    else it is kept and joins the vocabulary, with its definition, or with its own name where it has none. Triples come out with ``path``,
    ``canon`` (null only for a null relation) and ``score``. New relations are numbered in the order in which they joined.
    """
    t = written(triples.select("doc_ord", "pos", "s", "p", "o", "definition"), "triples")
    firsts = t.where("p IS NOT NULL").groupBy(F.col("p").alias("relation"), "definition").agg(F.min(F.struct("doc_ord", "pos")).alias("at"))
    firsts = firsts.select("relation", "definition", "at.doc_ord", "at.pos").join(small(schema.select("relation"), of=schema), "relation", "left_anti")
    vectors = embed(firsts.where("definition IS NOT NULL").select("definition").distinct(), "definition")
    pairs = written(firsts.join(vectors, "definition", "left"), "pairs")
    new = written(growth(pairs, schema, tau, unit), "growth")
    top = schema.agg(F.coalesce(F.max("ord"), F.lit(-1)).cast("bigint")).first()[0]
    own = new.withColumn("ord", (F.row_number().over(Window.orderBy("doc_ord", "pos")) + F.lit(top)).cast("bigint"))
    own = own.select("ord", "relation", F.coalesce("definition", "relation").alias("definition"), F.lit("enriched").alias("origin"), F.col("vector").alias("embedding"), "doc_ord", "pos")
    grown = written(schema.select("ord", "relation", "definition", "origin", "embedding", F.lit(None).cast("bigint").alias("doc_ord"), F.lit(None).cast("int").alias("pos")).unionByName(own), "grown")

    at = {"triple": F.struct("doc_ord", "pos"), "document": F.struct("doc_ord", F.lit(0).alias("pos")), "all": F.struct(F.lit(1).cast("bigint").alias("doc_ord"), F.lit(0).alias("pos"))}[unit]
    since = grown.select(F.col("relation").alias("p"), F.when(F.col("doc_ord").isNull(), F.struct(F.lit(None).cast("bigint").alias("doc_ord"), F.lit(None).cast("int").alias("pos"))).otherwise(
        at if unit != "all" else F.struct(F.lit(2).cast("bigint").alias("doc_ord"), F.lit(0).alias("pos"))).alias("since"), F.lit(True).alias("_in"))
    marked = t.withColumn("_at", at).join(small(since, of=grown), "p", "left")
    there = F.coalesce(F.col("_in"), F.lit(False)) & F.coalesce(F.col("since.doc_ord").isNull() | (F.col("since") < F.col("_at")), F.lit(False))
    marked = marked.withColumn("path", F.when(there, "exact").when(F.col("definition").isNull() | F.col("p").isNull(), "nodef").otherwise("verify")).drop("_in", "since")

    # of each definition the steps at which its best relation changed: a relation counts if none that was there before it is as good
    seen_by = schema if unit == "all" else grown
    steps = rising(vectors, ["definition"], "vector", seen_by.select("ord", "embedding"), tau).join(small(grown.select("ord", F.col("relation").alias("near"), F.when(F.col("doc_ord").isNotNull(), at).alias("from")), of=grown), "ord")
    steps = steps.groupBy("definition").agg(F.array_sort(F.collect_list(F.struct("score", "near", "from"))).alias("steps"))
    out = marked.join(steps, "definition", "left")
    seen = F.filter("steps", lambda x: x["from"].isNull() | (x["from"] < F.col("_at")))
    out = out.withColumn("_best", F.when(F.col("path") == "verify", F.try_element_at(seen, F.lit(-1))))
    canon = F.when(F.col("path") == "exact", F.col("p")).otherwise(F.coalesce("_best.near", "p"))
    result = out.select("doc_ord", "pos", "s", "p", "o", "definition", "path", canon.alias("canon"), F.col("_best.score").alias("score"))
    return result, grown.select("ord", "relation", "definition", "origin", "embedding")


def closed_by_model(triples: DataFrame, schema: DataFrame, embed: Callable[[DataFrame, str], DataFrame], model, instructions: str, template: str, k: int = 5, answer_parse: str = "exact") -> DataFrame:
    """As ``closed``, with a model as verifier that sees the text, the triple, its relation with definition, and the choices.

    triples has ``text`` too. Only triples on the path ``verify`` are put before the model, equal prompts once; what the answer's letter does not
    name is refused.
    """
    from tripleloom.functions.text import listed
    from tripleloom.operators.prompts import choices, chosen, fill

    marked = paths(triples, schema)
    asked = embed(marked.where("path = 'verify'").select("definition").distinct(), "definition")
    found = candidates(asked, ["definition"], "vector", schema, k)
    rows = marked.join(found, "definition", "left").withColumn("candidates", F.when(F.col("path") == "verify", F.col("candidates")))
    rows = written(rows, "candidates")
    put = rows.where("candidates IS NOT NULL").select(
        "doc_ord", "pos", "candidates", F.lit(instructions).alias("instructions"),
        fill(template, input_text=F.col("text"), query_triplet=listed(F.array("s", "p", "o")), query_relation=F.col("p"), query_relation_definition=F.col("definition"), choices=choices(F.col("candidates"))).alias("input"),
    )
    answers = model.complete(put).select("doc_ord", "pos", chosen(F.col("completion"), F.col("candidates"), answer_parse)["relation"].alias("_chosen"))
    out = rows.join(answers, ["doc_ord", "pos"], "left")
    return out.withColumn("canon", F.when(F.col("path") == "exact", F.col("p")).otherwise(F.col("_chosen"))).drop("_chosen", "text")


def _grown(decided: DataFrame, schema: DataFrame, embed: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The vocabulary with what decided triples have a null ``canon`` for, the first of each relation."""
    from tripleloom.operators.schema import upsert

    fresh = decided.where("canon IS NULL AND p IS NOT NULL").select(F.col("p").alias("relation"), F.coalesce("definition", "p").alias("definition"), F.struct("doc_ord", "pos").alias("at"))
    first = fresh.groupBy("relation").agg(F.min_by("definition", "at").alias("definition"), F.min("at").alias("at"))
    grown = upsert(schema.drop("embedding"), first)
    vectors = embed(grown.join(schema.select("ord"), "ord", "left_anti"), "definition").select("ord", F.col("vector").alias("_v"))
    return written(grown.join(schema.select("ord", "embedding"), "ord", "left").join(vectors, "ord", "left").withColumn("embedding", F.coalesce("embedding", "_v")).drop("_v"), "vocabulary")


def enriched_in_batches(triples: DataFrame, schema: DataFrame, decide: Callable[[DataFrame, DataFrame], DataFrame], embed: Callable[[DataFrame, str], DataFrame], batches: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(triples, schema): growth by any verifier, a batch of documents at a time.

    ``batches`` are conditions on triples, each a batch, in order; ``decide`` gives a batch and the vocabulary as of its start back with
    ``canon``. What it refuses joins the vocabulary after the batch. Batches are written as they are decided, so a verifier is asked once.
    """
    done = None
    for condition in batches:
        part = written(decide(triples.where(condition), schema), "batch")
        schema = _grown(part, schema, embed)
        part = part.withColumn("canon", F.coalesce("canon", "p"))
        done = part if done is None else done.unionByName(part)
    return done, schema


def enriched_in_order(triples: DataFrame, schema: DataFrame, decide: Callable[[DataFrame, DataFrame], DataFrame], embed: Callable[[DataFrame, str], DataFrame], unit: str = "document") -> tuple[DataFrame, DataFrame]:
    """(triples, schema): growth by any verifier, where each unit (triple, document) sees all that the units before it added; ``all`` is one batch.

    A verifier may judge each triple on its own, so no verdict follows from another. But while nothing is refused the vocabulary stays as it
    is: what is decided on it for many units at once stands up to and with the first unit that adds to it, and those after it are decided anew
    on the grown one. Only units with a relation that the vocabulary does not have are counted; their number doubles while nothing is added
    and is halved when something is. A verifier may thus be asked again about units that came after a refusal; one answer counts.
    """
    if unit == "all":
        return enriched_in_batches(triples, schema, decide, embed, [F.lit(True)])
    spark, target = triples.sparkSession, shared_path(triples.sparkSession, "decided")
    at = F.struct("doc_ord", F.col("pos") if unit == "triple" else F.lit(0).alias("pos"))
    place = lambda x: F.struct(F.lit(x.doc_ord).cast("bigint").alias("doc_ord"), F.lit(x.pos).cast("int").alias("pos"))
    rest = rows = written(triples.repartitionByRange("doc_ord").sortWithinPartitions("doc_ord", "pos"), "triples")
    width, last = 1, True
    while last:
        ahead = rest.where("p IS NOT NULL").join(small(schema.select(F.col("relation").alias("p")), of=schema), "p", "left_anti")
        last = ahead.select(at.alias("at")).distinct().orderBy("at").limit(width).agg(F.max("at")).first()[0]
        part = written(decide(rest.where(at <= place(last)) if last else rest, schema), "batch")
        first = part.where("canon IS NULL AND p IS NOT NULL").agg(F.min(at)).first()[0]
        if first:
            last, part = first, part.where(at <= place(first))
            schema = _grown(part, schema, embed)
        width = max(1, width // 2) if first else 2 * width
        part.withColumn("canon", F.coalesce("canon", "p")).write.mode("append").parquet(target)
        if last:
            rest = rows.where((F.col("doc_ord") >= last.doc_ord) & (at > place(last)))
    return spark.read.schema(part.schema).parquet(target), schema
