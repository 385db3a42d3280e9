import json
import random

import numpy as np
import regex

from conftest import rows
from tripleloom.llm import nearsets

PROFILE = "doc_ord bigint, business_summary string, id string, ws string"


def profiles(spark, texts):
    """Profiles with further columns whose names clash with those used inside."""
    data = [(i, t if t is None or t.startswith("{") else json.dumps({"summarization": t}), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, PROFILE)


def corpus(rng, n):
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            text = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                kind, at = rng.random(), rng.randrange(len(text))
                if kind < 0.4 and len(text) > 5:
                    del text[at]
                elif kind < 0.8:
                    text.insert(at, rng.choice(words))
                else:
                    rng.shuffle(text)
            out.append(" ".join(text))
        else:
            out.append(" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(6, 90))))
    return out


def brute(texts, t=0.75, least=8):
    sets = {i: set(x.lower().split()) for i, x in enumerate(texts)}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return sorted((i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]))


def test_pairs_and_groups_against_all_pairs(spark):
    texts = corpus(random.Random(3), 500) + ["one two three four five six seven eight nine ten"] * 40
    df = profiles(spark, texts)
    want = brute(texts)
    assert len(want) > 900
    assert sorted(map(tuple, nearsets.near_profiles(df).collect())) == want
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {r.doc_ord: r.group for r in nearsets.profile_groups(df).collect()} == {i: root(i) for i in range(len(texts))}


def test_other_similarities(spark):
    texts = corpus(random.Random(8), 250)
    for t, least in ((0.9, 3), (0.6, 8), (0.8, 1)):
        assert sorted(map(tuple, nearsets.near_profiles(profiles(spark, texts), t, least).collect())) == brute(texts, t, least)


def test_what_takes_no_part(spark):
    same = "a b c d e f g h"
    cases = [None, "", "a b c d e f g", same, '{"summarization": "a b c d e f g h"', '{"other": "a b c d e f g h"}', '{"summarization": 5}', '{"summarization": "H g, f E d-c B a!"}', same + " a"]
    df = profiles(spark, cases)
    assert rows(nearsets.near_profiles(df)) == [(3, 7), (3, 8), (7, 8)]
    assert rows(nearsets.profile_groups(df)) == sorted([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 3), (8, 3)])
    assert rows(nearsets.near_profiles(df.limit(0))) == [] == rows(nearsets.profile_groups(df.limit(0)))


def test_long_texts(spark):
    long = [f"x{i}" for i in range(20_000)]
    df = profiles(spark, [" ".join(long), " ".join(long[3000:]), " ".join(long[:9000])])
    assert rows(nearsets.near_profiles(df)) == [(0, 1)]


def test_a_third_in_one_class(spark):
    texts = ["a b c d e f g h i j"] * 60 + [f"p{i} q{i} r{i} s{i} t{i} u{i} v{i} w{i}" for i in range(120)]
    assert len(nearsets.near_profiles(profiles(spark, texts)).collect()) == 60 * 59 // 2


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1) if i != 150], "a bigint, b bigint")
    got = {r.id: r.group for r in nearsets.components(spark.range(n + 2), edges).collect()}
    left, right = min(order[:151]), min(order[151:])
    assert got == {**{x: left for x in order[:151]}, **{x: right for x in order[151:]}, n: n, n + 1: n + 1}


def test_bands_and_levels():
    bands = nearsets.Bands(0.75, 8)
    sizes = np.arange(8, 5000)
    band = bands.of_all(sizes)
    for s, b in zip(sizes.tolist(), band.tolist()):
        assert bands.low(b) <= s < bands.low(b + 1)
        assert b - int(bands.of_all(np.array([max(8, int(np.ceil(0.75 * s - 1e-9)))]))[0]) <= 1
    table = bands.segment_table(sizes)
    assert all(2 * table[b] >= bands.differ_all(np.array(s), np.array(min(s, bands.low(b + 1) - 1))) + 1 for s, b in zip(sizes.tolist(), band.tolist()))
    assert nearsets._levels([1.0, 100.0, 1.0], [3.0, 101.0, 50.0], 3) == [2, 0, 1]
    assert sum(nearsets._levels([5.0] * 4, [9.0] * 4, 8)) == 8


def test_marks_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        other = np.concatenate([base[4:], rng.integers(0, 2**63, 3, dtype=np.uint64)])
        a, b = (int(nearsets._marks(x, np.array([len(x)])).view(np.uint64)[0]) for x in (base, other))
        assert (a ^ b).bit_count() <= 7


def test_word_sets_of_ascii_and_of_other_texts():
    for text in ("A b_C, a-B9 x'y\x1fz\x00", "Äpfel ÄPFEL b_C İstanbul ½ ²x"):
        assert nearsets._word_set(text) == " ".join(sorted({x.lower() for x in regex.findall(r"[\p{L}\p{N}]+", text)}))
    assert nearsets._word_set(None) is None and nearsets._word_set("...") == ""


def test_links_say_what_the_pairs_say(spark):
    texts = corpus(random.Random(5), 200) + ["one two three four five six seven eight nine ten"] * 30 + [None, "too short"]
    links = {i: 0 for i, x in enumerate(texts) if x and len(set(x.split())) >= 8}
    for a, b in brute([x or "" for x in texts]):
        links[a] += 1
        links[b] += 1
    got = nearsets.linked_profiles(profiles(spark, texts)).collect()
    assert {r.doc_ord: r.links for r in got} == links
    assert {r.class_id for r in got if r.doc_ord in range(200, 230)} == {200}


def test_classes_of_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(nearsets, "BLOCK", 7)
    texts = ["a b c d e f g h i j"] * 50 + ["a b c d e f g h i j k"] * 20 + ["a b c d e f g h i x y z"]
    assert sorted(map(tuple, nearsets.near_profiles(profiles(spark, texts)).collect())) == brute(texts)


def test_nothing_that_grows_is_broadcast(spark):
    """With a limit that all tables here are below, the joins of keys and of word sets still go by shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        _, reps = nearsets.classes(nearsets.profile_sets(profiles(spark, corpus(random.Random(6), 60))))
        plan = nearsets.similar_sets(reps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
