import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripleloom.functions.similarity import nearest
from tripleloom.operators import canonicalize, providers, schema as vocabulary

SCHEMA = "ord bigint, relation string, definition string, origin string, embedding array<float>"
TRIPLES = "doc_ord bigint, pos int, s string, p string, o string, definition string"
AXES = {"dk": [1.0, 0.0], "near": [0.9, 0.1], "far": [0.0, 1.0], "d1": [1.0, 0.0], "d2": [0.95, 0.05]}


def embed_axes(spark):
    table = spark.createDataFrame(list(AXES.items()), "key string, vector array<float>")
    return providers.looked_up(table, lambda d: d)


def known(spark, *relations):
    return spark.createDataFrame([(i, r, d, "file", AXES[d]) for i, (r, d) in enumerate(relations)], SCHEMA)


def triples(spark, *items):
    return spark.createDataFrame([(d, i, "a", p, "b", x) for i, (d, p, x) in enumerate(items)], TRIPLES)


def test_closed_paths(spark):
    t = triples(spark, (1, "k", None), (1, "r", "near"), (1, "r", "near"), (1, "x", "far"), (1, "y", None), (1, None, "near"))
    got = canonicalize.closed(t, known(spark, ("k", "dk")), embed_axes(spark), canonicalize.threshold(0.5))
    assert [(r.path, r.canon) for r in got.orderBy("pos").collect()] == [("exact", "k"), ("verify", "k"), ("verify", "k"), ("verify", None), ("nodef", None), ("nodef", None)]


def test_closed_with_an_empty_vocabulary(spark):
    got = canonicalize.closed(triples(spark, (1, "r", "near")), known(spark).limit(0) if False else spark.createDataFrame([], SCHEMA), embed_axes(spark), canonicalize.threshold(0.5))
    assert [r.canon for r in got.collect()] == [None]


def test_visibility_of_new_relations(spark):
    """The smallest case in which the units differ: two new relations of one document that mean the same."""
    t = triples(spark, (1, "r1", "d1"), (1, "r2", "d2"), (2, "r3", "d2"))
    want = {"triple": ["r1", "r1", "r1"], "document": ["r1", "r2", "r1"], "all": ["r1", "r2", "r3"]}
    for unit, canon in want.items():
        got, grown = canonicalize.enriched(t, spark.createDataFrame([], SCHEMA), embed_axes(spark), 0.5, unit)
        assert [r.canon for r in got.orderBy("pos").collect()] == canon, unit
        assert [r.relation for r in grown.orderBy("ord").collect()] == list(dict.fromkeys(c for c, p in zip(canon, ["r1", "r2", "r3"]) if c == p))


def test_relation_without_definition_joins_by_its_name(spark):
    got, grown = canonicalize.enriched(triples(spark, (1, "r", None)), known(spark, ("k", "dk")), embed_axes(spark), 0.5)
    assert [(r.path, r.canon) for r in got.collect()] == [("nodef", "r")]
    assert [(r.ord, r.relation, r.definition, r.origin) for r in grown.orderBy("ord").collect()] == [(0, "k", "dk", "file"), (1, "r", "r", "enriched")]


def plain_fold(items, base, vector_of, tau, unit):
    """The same by going through the triples one by one. base: [(relation, vector)]; items: [(doc, pos, relation, definition)] in order."""
    vocabulary_, waiting, now, out = list(base), [], None, []
    for doc, pos, p, d in items:
        place = {"triple": (doc, pos), "document": doc, "all": 0}[unit]
        if place != now:
            vocabulary_ += waiting
            waiting, now = [], place
        names = [r for r, _ in vocabulary_]
        if p in names:
            out.append(p)
            continue
        best = None
        if d is not None:
            scored = [(round(float(np.dot(v, vector_of[d])), 6), -i, r) for i, (r, v) in enumerate(vocabulary_) if v is not None]
            best = max(scored, default=None)
        if best and best[0] >= tau:
            out.append(best[2])
        else:
            out.append(p)
            if p not in [r for r, _ in waiting]:
                waiting.append((p, None if d is None else vector_of[d]))
    return out, [r for r, _ in vocabulary_ + waiting]


@pytest.mark.parametrize("unit", ["triple", "document", "all"])
@pytest.mark.parametrize("seed,chunk,folded", [(1, 20_000, 1000), (2, 7, 1000), (3, 20_000, 3), (4, 5, 2)])
def test_growth_equals_a_plain_fold(spark, unit, seed, chunk, folded, monkeypatch):
    monkeypatch.setattr(canonicalize, "CHUNK", chunk)
    monkeypatch.setattr(canonicalize, "FOLDED", folded)
    rng = random.Random(seed)
    vector_of = {}
    for i in range(30):
        v = np.array([rng.gauss(0, 1) for _ in range(4)])
        vector_of[f"d{i}"] = [float(x) for x in np.float32(v / np.linalg.norm(v))]
    relations = [f"r{i}" for i in range(14)]
    items = [(doc, pos, rng.choice(relations), rng.choice([None, *vector_of] if rng.random() < 0.3 else list(vector_of))) for doc in range(25) for pos in range(rng.randint(0, 5))]
    base = [("r0", vector_of["d0"]), ("k", vector_of["d1"])]
    want, names = plain_fold(items, base, vector_of, 0.75, unit)
    t = spark.createDataFrame([(d, pos, "s", p, "o", x) for d, pos, p, x in items], TRIPLES)
    s = spark.createDataFrame([(i, r, r, "file", v) for i, (r, v) in enumerate(base)], SCHEMA)
    e = providers.looked_up(spark.createDataFrame(list(vector_of.items()), "key string, vector array<float>"), lambda d: d)
    got, grown = canonicalize.enriched(t, s, e, 0.75, unit)
    assert [r.canon for r in got.orderBy("doc_ord", "pos").collect()] == want
    assert [r.relation for r in grown.orderBy("ord").collect()] == names


def undefined_after_growth(spark, unit, monkeypatch):
    """What is folded after a relation with a vector joined: first a relation without a definition alone in its block, then one that is near."""
    monkeypatch.setattr(canonicalize, "FOLDED", 1)
    t = triples(spark, (1, "r", "far"), (2, "x", None), (3, "y", None), (4, "z", "near"), (5, "w", "d1"))
    got, grown = canonicalize.enriched(t, spark.createDataFrame([], SCHEMA), embed_axes(spark), 0.5, unit)
    assert [(r.path, r.canon) for r in got.orderBy("pos").collect()] == [("verify", "r"), ("nodef", "x"), ("nodef", "y"), ("verify", "z"), ("verify", "z")]
    assert [r.relation for r in grown.orderBy("ord").collect()] == ["r", "x", "y", "z"]


def test_growth_by_document_where_a_block_has_no_definition(spark, monkeypatch):
    undefined_after_growth(spark, "document", monkeypatch)


def test_growth_by_triple_where_a_block_has_no_definition(spark, monkeypatch):
    undefined_after_growth(spark, "triple", monkeypatch)


def test_batches_by_any_verifier(spark):
    t = triples(spark, (1, "r1", "d1"), (1, "r2", "far"), (2, "r3", "d2"))
    decide = lambda part, s: canonicalize.closed(part, s, embed_axes(spark), canonicalize.threshold(0.5))
    out, grown = canonicalize.enriched_in_batches(t, spark.createDataFrame([], SCHEMA), decide, embed_axes(spark), [F.col("doc_ord") == 1, F.col("doc_ord") == 2])
    assert [r.canon for r in out.orderBy("pos").collect()] == ["r1", "r2", "r1"]
    assert [r.relation for r in grown.orderBy("ord").collect()] == ["r1", "r2"]


@pytest.mark.parametrize("strategy", ["matrix", "native"])
def test_nearest_breaks_ties_by_ord(spark, strategy):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "ord bigint, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "id bigint, v array<float>")
    assert rows(nearest(q, ["id"], "v", v, 2, strategy)) == [(7, 1, 1, 1.0), (7, 2, 3, 1.0)]
    assert rows(nearest(q, ["id"], "v", v.limit(0), 2, strategy)) == []


def test_strategies_agree_and_blocks_too(spark, monkeypatch):
    from tripleloom.functions import similarity

    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(50)], "ord bigint, embedding array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)], "id bigint, v array<float>")
    want = rows(nearest(q, ["id"], "v", v, 5, "native"))
    assert rows(nearest(q, ["id"], "v", v, 5)) == want
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 7 * 8 * 8)
    monkeypatch.setattr(similarity, "CELLS", 20)
    assert rows(nearest(q, ["id"], "v", v, 5)) == want


def test_plans(spark):
    s = known(spark, ("k", "dk"), ("l", "far"))
    t = triples(spark, (1, "k", None))
    assert "BroadcastHashJoin" in vocabulary.known(t, s)._jdf.queryExecution().toString()
    q = spark.createDataFrame([(7, [1.0, 0.0])], "id bigint, v array<float>")
    plan = nearest(q, ["id"], "v", s.select("ord", "embedding"), 2, "native")._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange hash" not in plan and "Python" not in plan and "MapInArrow" not in plan


def test_last_wins_keeps_the_first_place_and_nulls(spark):
    df = spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "a", None), (3, "A", "4"), (4, None, "5")], "ord bigint, relation string, definition string")
    assert rows(vocabulary.last_wins(df).select("ord", "relation", "definition")) == sorted([(0, "a", None), (1, "b", "2"), (3, "A", "4")], key=repr)


def test_definition_needs_the_exact_relation(spark):
    t = triples(spark, (1, " serves", None)).drop("definition")
    d = spark.createDataFrame([(1, "serves", "x")], "doc_ord bigint, relation string, definition string")
    assert vocabulary.with_definitions(t, d).first().definition is None
    assert vocabulary.with_definitions(t, d, normalize=True).first().definition == "x"
    assert rows(vocabulary.undefined(t, d)) == [(1, " serves")]
