"""Problems 6 to 8, against the tokenizers library."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from conftest import rows
from tripleloom.llm import mixing, pieces, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.FOLDER}/{tokens.NAME}.tiktoken"), reason="no tokenizer files")

ODD = [
    None, "", " ", "\n\n\n", "a", "<|endoftext|> hi", "it's 'sabc ''s don't DON'T we'll", "\x1c\x1d a \x85 b​ c", "𠮷野家 ½ ² ⅷ ١٢", "éä", "a" * 3000, "-" * 500, "ab c  d   \n\n e \t f  ", "𝒳𝓎 Ⅻ〇", "日本語の文章です。" * 30,
    "😀" * 40, " \n" * 100, "x'" * 50, "naïve café", "   leading", "\u0000\u0001", "ÀÉ́ combining", "한국어 텍스트", "tab\tand\rreturn",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/{tokens.NAME}.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def documents(spark, items):
    """Documents with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, s, t, 5, "x") for i, (s, t) in enumerate(items)], "doc_id bigint, source string, text string, n_tokens int, ids string")


def test_ids(spark, library):
    rng = random.Random(1)
    soup = ["".join(rng.choices("ab é'\n日s1.-😀 \t", k=rng.randint(0, 60))) for _ in range(1500)]
    texts = ODD + soup
    got = {r.doc_id: r.ids for r in tokens.encoded(documents(spark, [("s", t) for t in texts])).collect()}
    assert got == {i: library(t) for i, t in enumerate(texts)}
    assert rows(tokens.encoded(documents(spark, [("s", "x")]).limit(0))) == []


def test_kept_words_may_run_out(spark, library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    words = tokens.Words(f"{tokens.FOLDER}/{tokens.NAME}.tiktoken")
    for text in ("one two three four five six seven", "eight nine one", "two two"):
        (cut,) = words.split([text])
        assert [i for w in cut for i in words.ids[words.number[w]]] == library(text)


def test_counts(spark, library):
    got = tokens.counted(documents(spark, [("s", t) for t in ODD]), ["doc_id", "source"])
    assert rows(got) == sorted(((i, "s", len(library(t))) for i, t in enumerate(ODD)), key=repr)


def test_slices():
    assert list(tokens.slices(["aa", None, "b", "cccc", "d"], 3)) == [(0, 3), (3, 4), (4, 5)]
    assert list(tokens.slices([])) == []


def targets(spark, *rows_):
    return spark.createDataFrame(rows_, "source string, target_share double, max_repeats int")


def test_mix_reaches_its_shares(spark, library):
    rng = random.Random(2)
    word = lambda: rng.choice(["red", "green", "blue", "fish"])
    items = [("big", " ".join(word() for _ in range(20))) for _ in range(3000)] + [("small", " ".join(word() for _ in range(20))) for _ in range(300)] + [("tiny", "one two")] * 3 + [("other", "x")] * 5 + [(None, "y"), ("big", None), ("big", "")]
    mix = mixing.Mix(documents(spark, items), targets(spark, ("big", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.1, 2), ("none", 0.0, 1)))
    shares = {r.source: r for r in mix.shares().collect()}
    assert shares["tiny"].rate == 2 and shares["none"].rate == 0 and shares["small"].rate <= 4
    total = sum(s.available_tokens for s in shares.values())
    reached = sum(s.mix_tokens for s in shares.values())
    assert 0.7 < shares["big"].rate < 0.8 and abs(reached - total) < 0.1 * total
    assert abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    records = mix.records().collect()
    sums, repeats = {}, {}
    for r in records:
        sums[r.source] = sums.get(r.source, 0) + len(library(r.text))
        repeats.setdefault(r.doc_id, []).append(r.copy_no)
    assert sums == {k: s.mix_tokens for k, s in shares.items() if s.mix_tokens}
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in repeats.values())
    again = mixing.Mix(documents(spark, items).repartition(3), mix.targets)
    assert rows(again.records()) == rows(mix.records())


@pytest.mark.parametrize("sources", [[("a", 0.5, 1, 100), ("b", 0.5, 1, 100)], [("a", 0.9, 2, 100), ("b", 0.1, 9, 1000)], [("a", 1.0, 3, 0)], [("a", 0.5, 1, 10), ("b", 0.5, 1, 1000)], []])
def test_rates(sources):
    data = [mixing.Source(*s) for s in sources]
    got = mixing.rates(data)
    assert all(0 <= got[s.source] <= s.max_repeats for s in data)
    total, reached = sum(s.available for s in data), sum(got[s.source] * s.available for s in data)
    assert reached <= total + 1e-6
    if any(s.available and got[s.source] < s.max_repeats for s in data):
        assert abs(reached - total) < 1e-6


def test_mix_of_nothing(spark):
    mix = mixing.Mix(documents(spark, [("s", "x")]).limit(0), targets(spark, ("s", 1.0, 2)))
    assert rows(mix.records()) == [] and [(r.rate, r.mix_tokens, r.actual_share) for r in mix.shares().collect()] == [(0.0, 0, 0.0)]


def limits(spark):
    return spark.createDataFrame([("a", 40, 8), ("b", 25, 0), ("c", 10, 10), ("d", 3, 1)], "source string, max_tokens int, overlap_tokens int")


def test_pieces(spark, library):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "restaurant", "it's"]) for _ in range(rng.randint(3, 12))) + rng.choice([". ", "! ", ".\n", ".\n\n", ", "])
    items = [(rng.choice("abcd"), "".join(sentence() for _ in range(rng.randint(0, 25)))) for _ in range(200)]
    items += [(s, t) for s in ("a", "b", "c", "d", "zz", None) for t in ODD]
    found = {}
    for r in pieces.pieces(documents(spark, items), limits(spark)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(range(len(items)))
    most = {"a": (40, 8), "b": (25, 0), "c": (10, 0), "d": (3, 1)}
    for i, (source, text) in enumerate(items):
        ps = sorted(found[i], key=lambda r: r.piece_no)
        n = len(library(text))
        assert [p.piece_no for p in ps] == list(range(len(ps))) and all(p.n_pieces == len(ps) for p in ps)
        limit, overlap = most.get(source, (None, 0))
        if limit is None or n <= limit:
            assert len(ps) == 1 and ps[0].text == text and ps[0].end_token == n
            continue
        assert ps[0].start_char == 0 and ps[-1].end_char == len(text) and ps[-1].end_token == n
        for p in ps:
            assert p.text == text[p.start_char : p.end_char]
            assert len(library(p.text)) <= max(limit, 4) and (len(library(p.text)) <= limit or len(p.text) == 1)
        for p, q in zip(ps, ps[1:]):
            assert p.start_char < q.start_char <= p.end_char and q.end_char > p.end_char
            if source in "abc":
                assert overlap <= p.end_token - q.start_token <= overlap + 3


def test_pieces_end_where_the_text_pauses(spark):
    text = " ".join(f"Word{i} is here and there." for i in range(100))
    got = sorted(pieces.pieces(documents(spark, [("a", text)]), limits(spark)).collect(), key=lambda r: r.piece_no)
    assert len(got) > 10 and all(p.text.endswith(".") for p in got)


def test_pieces_end_where_the_topic_changes(spark):
    fish = "The fishes swim below waves near coral reefs. " * 2
    stars = "Distant galaxies contain planets orbiting bright stars. " * 2
    text = (fish + stars + fish + stars).strip()
    lim = spark.createDataFrame([("a", 30, 0)], "source string, max_tokens int, overlap_tokens int")
    got = sorted(pieces.pieces(documents(spark, [("a", text)]), lim, pieces.Cohesion(block=10)).collect(), key=lambda r: r.piece_no)
    assert [p.text.strip() for p in got] == [x.strip() for x in (fish, stars, fish, stars)]


def test_cosine_against_counters():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-1, 6, (50, 12)) for _ in range(2))
    a[0] = -1
    for x, y, got in zip(a, b, pieces._cosine(a, b)):
        x, y = Counter(x[x >= 0].tolist()), Counter(y[y >= 0].tolist())
        dot, norm = sum(x[k] * y[k] for k in x), (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        assert abs(got - (dot / norm if norm else 0.0)) < 1e-12


@pytest.mark.parametrize("fill", [0.0, 0.5])
def test_every_cut_is_the_deepest_valley_of_its_window(spark, fill):
    rng = random.Random(11)
    topics = [[f"{c}{x}" for x in ("alpha", "river", "stone", "garden")] for c in "abcd"]
    text = " ".join(" ".join(rng.choices(topics[i // 9 % 4], k=rng.randint(4, 9))) + "." for i in range(120))
    words = tokens.Words(f"{tokens.FOLDER}/{tokens.NAME}.tiktoken")
    kinds = pieces._Kinds(words, 4)
    (ws,) = words.split([text])
    kinds.update()
    o = pieces.Cohesion(block=20, fill=fill)
    t = pieces._Text(ws, words.numbers(ws), words, kinds, o)
    where, depth = t.at[t.pauses], t.depth
    found = list(t.pieces(200, 20))
    assert len(found) > 5
    for k, (start, _, end, _) in enumerate(found[:-1]):
        low = max(found[k - 1][2] if k else 0, start + 23)
        inside = [i for i, x in enumerate(where) if max(low, start + int(200 * fill)) < x <= start + 200]
        assert end in where and depth[list(where).index(end)] == max(depth[i] for i in inside)


def test_pieces_of_nothing(spark):
    assert rows(pieces.pieces(documents(spark, [("a", "x")]).limit(0), limits(spark))) == []
