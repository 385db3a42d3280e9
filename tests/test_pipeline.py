import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripleloom import storage
from tripleloom.config import Config, is_remote, parse_args
from tripleloom.operators import groups, hints, prompts, providers, schema as vocabulary
from tripleloom.plans import pipeline
from tripleloom.sources import documents, sinks
from tripleloom.streaming import enrich

TRIPLE = "doc_ord bigint, pos int, s string, p string, o string"


def test_values_are_not_filled_twice(spark):
    df = spark.createDataFrame([("{b}", "x"), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(prompts.fill("{{}} {a}-{b}", a=F.col("a"), b=F.col("b"))).collect()] == ["{} {b}-x", "{} -y"]
    with pytest.raises(KeyError):
        prompts.fill("{c}", a=F.col("a"))


def test_choices_and_answers(spark):
    df = spark.createDataFrame([([("r", "d", 0.5), ("q", None, 0.1)],)], "c array<struct<relation: string, definition: string, score: double>>")
    assert df.select(prompts.choices(F.col("c"))).first()[0] == "A. 'r': d\nB. 'q': \nC. None of the above.\n"
    for answer, exact, first in (("A", "r", "r"), ("B.", None, "q"), ("C", None, None), ("", None, None), (None, None, None), ("a", None, None)):
        row = df.select(*[prompts.chosen(F.lit(answer).cast("string"), F.col("c"), m)["relation"].alias(m) for m in ("exact", "first_char")]).first()
        assert (row.exact, row.first_char) == (exact, first)


def test_hint_numbers_have_gaps(spark):
    docs = spark.createDataFrame([(1, ["p2", "p1", "zz"], ["p1", "q"]), (2, None, None)], "doc_ord bigint, a array<string>, b array<string>")
    merged = docs.select("doc_ord", hints.united(F.col("a"), F.col("b")).alias("relations"))
    assert rows(merged) == [(1, ["p2", "p1", "zz", "q"]), (2, [])]
    schema = spark.createDataFrame([("p1", "d1"), ("p2", "d2"), ("q", "dq")], "relation string, definition string")
    examples = groups.numbered_examples(spark.createDataFrame([("q", 9, 0, ["a", "q", "b"])], "relation string, doc_ord bigint, pos int, triplet array<string>"))
    texts = spark.createDataFrame([(9, 'say "x"')], "doc_ord bigint, text string")
    got = {r.doc_ord: r.relation_hint for r in hints.relation_hints(merged, schema, examples, texts).collect()}
    assert got == {1: "1. p2: d2\n2. p1: d1\n4. q: dq\nFor example, ['a', 'q', 'b'] can be extracted from \"say \"x\"\"\n", 2: ""}


def test_results_keep_duplicates_and_empty_documents(spark):
    docs = spark.createDataFrame([(0, "5"), (1, None), (2, "x")], "doc_ord bigint, iid string")
    t = spark.createDataFrame([(0, 1, "a", "r", "b"), (0, 0, "c", "r", "d"), (0, 2, "a", "r", "b"), (2, 0, None, None, None)], TRIPLE)
    assert rows(groups.results(docs, t)) == [(0, "5", [["c", "r", "d"], ["a", "r", "b"], ["a", "r", "b"]]), (1, "1", []), (2, "x", [])]


def test_one_malformed_triple_voids_guarded_sets(spark):
    df = spark.createDataFrame([(1, [["b", "r", "a"]]), (2, [["b", "r", "a"], ["x"]]), (3, []), (4, None), (5, [None])], "doc_ord bigint, triples array<array<string>>")
    assert rows(groups.guarded_sets(df)) == [(1, ["a", "b"], ["r"]), (2, [], []), (3, [], []), (4, [], []), (5, [], [])]


def test_example_draws_repeat(spark):
    t = spark.createDataFrame([(i, 0, "a", "r", str(i), f"t{i}") for i in range(50)], TRIPLE + ", text string")
    wanted = spark.createDataFrame([(d, r) for d in range(200) for r in ("r", "none")], "doc_ord bigint, relation string")
    one, two = (rows(groups.drawn_examples(wanted, groups.numbered_examples(groups.examples_of(t.repartition(n)), 8), 7)) for n in (1, 5))
    assert one == two and len(one) == 200 and len({r[2] for r in one}) > 40


@pytest.mark.parametrize("few", [0, 64])
def test_examples_are_numbered_without_gaps(spark, few, monkeypatch):
    monkeypatch.setattr(groups, "FEW", few)
    t = spark.createDataFrame([(i, i % 3, "a", "r" if i % 4 else "q", str(i)) for i in range(40)] + [(50, 0, "a", None, "b")], TRIPLE)
    numbered = groups.numbered_examples(groups.examples_of(t), 3)
    assert {(r.relation, r.number, r.many) for r in numbered.collect()} == {("r", i, 30) for i in range(30)} | {("q", i, 10) for i in range(10)}
    drawn = groups.drawn_examples(spark.createDataFrame([(d, "q") for d in range(100)], "doc_ord bigint, relation string"), numbered, 7).collect()
    assert len(drawn) == 100 and {r.source for r in drawn} == set(range(0, 40, 4)) and all(r.triplet[2] == str(r.source) for r in drawn)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_plain_text(spark, tmp_path):
    docs, bad = documents.read_documents(spark, write(tmp_path / "a.txt", " one 　\n\ntwo\n"))
    assert rows(docs) == [(0, "0", "one"), (1, "1", ""), (2, "2", "two")] and rows(bad) == []
    docs, _ = documents.read_documents(spark, write(tmp_path / "b.txt", "123\n[1]\n"))
    assert rows(docs) == [(0, "0", "123"), (1, "1", "[1]")]
    docs, _ = documents.read_documents(spark, write(tmp_path / "c.txt", ""))
    assert rows(docs) == []


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    sizes = {"a": 700, "b": 3, "c": 2500, "d": 0, "e": 900}
    for name, n in sizes.items():
        write(tmp_path / f"d/{name}.txt", "".join(f"{name}{i}\n" for i in range(n)))
    want = [f"{name}{i}" for name, n in sizes.items() for i in range(n)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = documents.numbered_lines(spark, str(tmp_path / "d"))
        assert lines.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert {r.doc_ord: r.line for r in lines.collect()} == dict(enumerate(want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_json_lines_of_three_layouts(spark, tmp_path):
    lines = [
        json.dumps({"iid": 5, "business summary": json.dumps({"summarization": "fine"})}), json.dumps({"iid": 7, "business summary": json.dumps({"x": 1})}), json.dumps({"iid": 8, "business summary": "not json"}),
        json.dumps({"text": "t", "id": "z"}), json.dumps({"text": "u"}), '{"other": 1}', "", "{broken", '{"text": "u"} tail',
    ]
    path = write(tmp_path / "a.jsonl", "\n".join(lines) + "\n")
    docs, bad = documents.read_documents(spark, path)
    assert rows(docs) == [(0, "5", "fine"), (1, "7", ""), (2, "8", ""), (3, "z", "t"), (4, "4", "u"), (5, "5", '{"other": 1}')]
    assert rows(bad) == [(6, ""), (7, "{broken"), (8, '{"text": "u"} tail')]
    with pytest.raises(ValueError):
        documents.read_documents(spark, path, strict=True)


def test_schema_file(spark, tmp_path):
    path = write(tmp_path / "s.csv", 'a,one\nb,"two, with ""quotes"""\na,three\n')
    assert rows(documents.read_schema(spark, path)) == [(0, "a", "three", "file"), (1, "b", 'two, with "quotes"', "file")]
    assert rows(documents.read_schema(spark, "")) == []
    with pytest.raises(Exception):
        documents.read_schema(spark, write(tmp_path / "bad.csv", "a,b,c\n")).collect()


def test_literal_results(spark, tmp_path):
    got = documents.read_literal_results(spark, write(tmp_path / "kg.txt", "[['a', 'r', 'b'], ['c', 'r', 1]]\nno\n[]\n"))
    assert rows(got) == [(0, [["a", "r", "b"], ["c", "r", "1"]]), (1, None), (2, [])]


def test_replay_and_prompt_keys(spark):
    asked = spark.createDataFrame([(1, "i", "x"), (2, "i", "y"), (3, "i", "x")], "k int, instructions string, input string")
    recorded = asked.where("k = 1").select(providers.prompt_hash(F.col("instructions"), F.col("input")).alias("prompt_hash"), F.lit("done").alias("completion"))
    assert rows(providers.Replay(recorded).complete(asked).select("k", "completion")) == [(1, "done"), (2, None), (3, "done")]


def test_remote_asks_equal_prompts_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def call(instructions, text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "bad":
            raise ValueError
        return text.upper()

    asked = spark.createDataFrame([(1, "i", "x"), (2, "i", "bad"), (3, "i", "x")], "k int, instructions string, input string")
    out = providers.Remote(call, tasks=2, attempts=2, pause=0).complete(asked)
    assert rows(out.select("k", "completion")) == [(1, "X"), (2, None), (3, "X")] == rows(out.select("k", "completion"))
    assert sorted(open(log).read().split()) == ["bad", "bad", "x"]


def test_local_model_and_release(spark):
    asked = spark.createDataFrame([(1, "i", "x")], "k int, instructions string, input string")
    assert providers.Local("m", lambda: (lambda a, b: a + b), prepend="!").complete(asked).first().completion == "ix!"
    assert providers.loaded("n", lambda: 5) == 5
    providers.release("n")
    assert providers.loaded("n", lambda: 6) == 6


def test_rate_limiter():
    now, slept = [0.0], []

    def sleep(t):
        slept.append(t)
        now[0] += t

    limit = providers.RateLimiter(2, lambda: now[0], sleep)
    for _ in range(5):
        limit.wait()
    assert slept == [1.0, 1.0] and providers.with_retries(lambda: int("x"), 3, 0.5, slept.append) is None and slept[2:] == [0.5, 0.5]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = [r.vector for r in providers.hashed(16)(df, "t").collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5 and got[1] == [0.0] * 16 and got[2] is None


def test_config():
    cfg = parse_args(["--refinement-iterations", "2", "--enrich_schema", "--log_level", "debug", "--enable-parallel-requests", "false"])
    assert (cfg.refinement_iterations, cfg.enrich_schema, cfg.enable_parallel_requests) == (2, True, False)
    assert is_remote("My-GPT-4") and not is_remote("rules") and cfg.models() == {"rules"}
    with pytest.raises(ValueError):
        Config(batch_unit="x")


def models():
    echo = providers.Rules(lambda i, x: F.regexp_extract(x, r"(?s)Text: (.*?)(\nEntities|$)", 1))
    said = providers.Rules(lambda i, x: F.array_join(F.transform(F.regexp_extract_all(F.substring_index(x, "Relations: ", -1), F.lit("'([^']*)'"), F.lit(1)), lambda r: F.concat(r, F.lit(": it "), r)), "\n"))
    return pipeline.Models(oie=echo, sd=said, ee=echo)


def test_two_passes_with_growth_and_output(spark, tmp_path):
    docs = spark.createDataFrame([(0, "5", "[['a','r','b'],['c','new thing','d']]"), (1, None, ""), (2, "x", "[['e', None, 'f'], ['é', 'r', 'h']]"), (3, "y", None)], "doc_ord bigint, iid string, text string")
    schema = spark.createDataFrame([(0, "r", "it r", "file")], "ord bigint, relation string, definition string, origin string")
    out = str(tmp_path / "out")
    cfg = Config(refinement_iterations=1, enrich_schema=True, threshold=0.9, output_dir=out)
    passes = pipeline.run(docs, schema, cfg, models(), output=True)
    want = [(0, "5", [["a", "r", "b"], ["c", "new thing", "d"]]), (1, "1", []), (2, "x", [["é", "r", "h"]]), (3, "y", [])]
    assert [rows(p.results) for p in passes] == [want, want]
    assert rows(passes[0].rejects) == [(2, "['e', None, 'f']")]
    assert rows(passes[1].schema.select("relation", "origin")) == [("new thing", "enriched"), ("r", "file")]
    trace = {r["index"]: r for r in passes[1].trace.collect()}
    assert trace[0].oie == [["a", "r", "b"], ["c", "new thing", "d"]] and trace[0].schema_definition["r"] == "it r"
    assert "1. new thing: it new thing\n" in trace[0].relation_hint and set(trace[0].entity_hint) >= {"a", "b", "c", "d"}
    assert passes[0].trace.where("entity_hint IS NOT NULL").isEmpty()
    file = str(tmp_path / "kg.json")
    sinks.export_array(spark, f"{out}/iter=1/canon_kg", file)
    assert [(r["iid"], r["triplets"]) for r in json.load(open(file))] == [(5, want[0][2]), (1, []), ("x", want[2][2]), ("y", [])]
    assert "\\u00e9" in "".join(x.value for x in spark.read.text(f"{out}/iter=0/result_at_each_stage").collect()).lower()
    with pytest.raises(FileExistsError):
        pipeline.run(docs, schema, cfg, models(), output=True)


def test_empty_vocabulary_leaves_nothing(spark):
    docs = spark.createDataFrame([(0, "5", "[['a','r','b']]")], "doc_ord bigint, iid string, text string")
    empty = documents.read_schema(spark, None)
    last = pipeline.run(docs, empty, Config(refinement_iterations=1), models())[-1]
    assert rows(last.results) == [(0, "5", [])] and last.trace.first().schema_canonicalizaiton == [None]


def test_a_model_as_verifier(spark):
    docs = spark.createDataFrame([(0, "5", "[['a','q','b'],['a','z','c']]")], "doc_ord bigint, iid string, text string")
    schema = spark.createDataFrame([(0, "r", "it q", "file")], "ord bigint, relation string, definition string, origin string")
    m = models()
    m.sc = providers.Rules(lambda i, x: F.when(F.contains(x, F.lit("Relation: q:")), "A").otherwise("B"))
    first = pipeline.run(docs, schema, Config(), m)[0]
    assert rows(first.results) == [(0, "5", [["a", "r", "b"]])]
    grown = pipeline.run(docs, schema, Config(enrich_schema=True), m)[0]
    assert rows(grown.results) == [(0, "5", [["a", "r", "b"], ["a", "z", "c"]])] and rows(grown.schema.select("relation")) == [("r",), ("z",)]


@pytest.mark.parametrize("unit", ["triple", "document", "all"])
def test_a_model_sees_the_vocabulary_grow(spark, unit):
    """Relations q... mean what the relation n that an earlier unit adds means; the model says so only where n is among the choices."""
    lines = [[("a", "r", "b")], [("a", "n", "b"), ("c", "q1", "d")], [("a", "r", "b")], [("a", "q2", "b")], [], [("a", "m", "b"), ("a", "q1", "c")]]
    docs = spark.createDataFrame([(i, str(i), str([list(t) for t in x])) for i, x in enumerate(lines)], "doc_ord bigint, iid string, text string")
    schema = spark.createDataFrame([(0, "r", "it r", "file")], "ord bigint, relation string, definition string, origin string")
    m = models()
    letter = lambda x: F.regexp_extract(x, r"(?m)^([A-Z])\. 'n'", 1)
    m.sc = providers.Rules(lambda i, x: F.when(F.contains(x, F.lit("Relation: q")), letter(x)).otherwise(""))
    got = pipeline.run(docs, schema, Config(enrich_schema=True, batch_unit=unit), m)[0]
    relations = {int(r.iid): [t[1] for t in r.triplets] for r in got.results.collect()}
    q1, q2, q3 = {"triple": ("n", "n", "n"), "document": ("q1", "n", "q1"), "all": ("q1", "q2", "q1")}[unit]
    assert relations == {0: ["r"], 1: ["n", q1], 2: ["r"], 3: [q2], 4: [], 5: ["m", q3]}
    names = list(dict.fromkeys(["r", "n", *(x for x in (q1, q2) if x != "n"), "m"]))
    assert [r.relation for r in got.schema.orderBy("ord").collect()] == names


def test_queries_over_whole_runs_know_the_whole_vocabulary(spark, tmp_path):
    """One relation of the vocabulary for each of two beginnings, one that means the same as a known one, and one that nothing is near to."""
    from tripleloom.queries import QUERIES

    strange = "is by no means whatsoever comparable with or similar to anything that anybody ever knew before"
    kg = [(0, "5", [["a", "is a", "b"]]), (1, "6", [["a", "provides", "b"]]), (2, "7", [["a", strange, "b"]]), (3, "8", [["c", "has feature", "d"]])]
    schema = [(0, "serves", "The subject entity provides the object entity."), (1, "is a", "kind"), (2, "has feature", "trait")]
    folder = str(tmp_path)
    spark.createDataFrame(kg, "doc_ord bigint, iid string, triplets array<array<string>>").write.parquet(f"{folder}/canon_kg.parquet")
    vectors = {0: [1.0, 0.0], 1: [-1.0, 0.0], 2: [-1.0, 0.0]}
    spark.createDataFrame([(*x, "file", vectors[x[0]]) for x in schema], "ord bigint, relation string, definition string, origin string, embedding array<float>").write.parquet(f"{folder}/relation_schema.parquet")
    key = lambda p: (len(p) + 38) * 31 + ord(p[0]) * 7  # noqa: E731  # as the queries look definitions up
    assert key("provides") % 2 == 0 and key(strange) % 2 == 1
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    fixed = [(0, "5", "a|is a|b"), (1, "6", "a|serves|b"), (2, "7", ""), (3, "8", "c|has feature|d")]
    assert rows(QUERIES["pipeline_run"](spark, folder)) == fixed
    assert rows(QUERIES["refine_two_pass"](spark, folder)) == [*fixed[:2], (2, "7", f"a|{strange}|b"), fixed[3]]
    assert [r.schema_canonicalizaiton for r in QUERIES["stage_trace"](spark, folder).orderBy("index").collect()] == ["a|is a|b", "a|serves|b", "None", "c|has feature|d"]
    streamed = rows(QUERIES["stream_enrich"](spark, folder).select("doc_ord", "path", "canon"))
    assert [streamed[i] for i in (0, 3)] == [(0, "exact", "is a"), (3, "exact", "has feature")] and [x[2] for x in streamed[1:3]] == ["serves", strange]


def small_files(spark):
    """Tables of a run that grow with the documents, of a few bytes as files, so that Spark would broadcast each: documents, nested and long triples, definitions."""
    docs = storage.written(spark.range(20).select(F.col("id").alias("doc_ord"), F.col("id").cast("string").alias("iid"), F.lit("t").alias("text")), "documents")
    nested = storage.written(docs.select("doc_ord", F.array(F.array(F.lit("a"), F.lit("r"), F.lit("b"))).alias("triples")), "oie")
    defined = storage.written(docs.select("doc_ord", F.lit("r").alias("relation"), F.lit("it r").alias("definition")), "definitions")
    return docs, nested, storage.written(groups.long_triples(nested), "long"), defined


def test_tables_of_a_run_are_not_broadcast(spark, monkeypatch):
    docs, nested, triples, defined = small_files(spark)
    monkeypatch.setattr(pipeline, "written", lambda df, name: df)
    asked = pipeline.define(docs, nested, triples, Config(), models())
    for df in (asked, vocabulary.with_definitions(triples, defined), vocabulary.undefined(triples, defined), groups.results(docs, triples)):
        assert "Broadcast" not in df._jdf.queryExecution().toString()
    assert vocabulary.with_definitions(triples, defined).where("definition = 'it r'").count() == 20 and groups.results(docs, triples).where("size(triplets) = 1").count() == 20


def test_parts_of_the_trace_are_not_broadcast(spark):
    docs, nested, triples, defined = small_files(spark)
    empty = docs.select("doc_ord", F.lit(None).cast("array<string>").alias("entity_hint"), F.lit("").alias("relation_hint"))
    out = storage.written(triples.withColumns({"canon": F.col("p"), "candidates": F.lit(None).cast("array<struct<relation: string, definition: string, score: double>>")}), "canonical")
    trace = sinks.trace_records(docs, empty, nested, defined, out)
    assert "Broadcast" not in trace._jdf.queryExecution().toString()
    assert {tuple(r.schema_definition.items()) for r in trace.collect()} == {(("r", "it r"),)} and trace.count() == 20


def test_unanswered_documents_are_set_apart(spark):
    docs = spark.createDataFrame([(0, "5", "[['a','r','b']]"), (1, "6", "x")], "doc_ord bigint, iid string, text string")
    m = models()
    m.oie = providers.Rules(lambda i, x: F.when(F.contains(x, F.lit("Text: x")), None).otherwise("[['a','r','b']]"))
    _, long, bad = pipeline.extract(docs, None, Config(), m)
    assert rows(bad) == [(1, pipeline.UNANSWERED)] and rows(long.select("doc_ord", "p")) == [(0, "r")]


def test_a_busy_endpoint_is_given_time():
    from urllib.error import HTTPError

    def failing(code):
        raise HTTPError("http://x", code, "", None, None)

    for code, want in ((429, [4.0, 16.0]), (503, [4.0, 16.0]), (500, [1.0, 1.0])):
        slept = []
        assert providers.with_retries(lambda: failing(code), 3, 1.0, slept.append) is None and slept == want


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_ord bigint, iid string, text string")
    schema = spark.createDataFrame([(0, "r", "it r", "file")], "ord bigint, relation string, definition string, origin string")
    assert [rows(p.results) for p in pipeline.run(docs, schema, Config(refinement_iterations=1, enrich_schema=True), models())] == [[], []]


def test_stream_equals_one_run(spark, tmp_path):
    from tripleloom.operators import canonicalize

    data = [(d, 0, "a", f"r{d % 4}", "b", f"it r{d % 4 // 2}") for d in range(12)]
    ddl = TRIPLE + ", definition string"
    for k in range(3):
        spark.createDataFrame(data[4 * k : 4 * k + 4], ddl).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    schema = spark.createDataFrame([], "ord bigint, relation string, definition string, origin string, embedding array<float>")
    e = providers.hashed()
    want, grown = canonicalize.enriched(spark.createDataFrame(data, ddl), schema, e, 0.9)
    stream = spark.readStream.schema(spark.createDataFrame([], ddl).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    v, out = enrich.Vocabulary(schema), str(tmp_path / "out")
    enrich.enrich_stream(stream, v, e, 0.9, out, str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(out).select("doc_ord", "canon")) == rows(want.select("doc_ord", "canon"))
    assert rows(v.at(2).select("relation")) == rows(grown.select("relation"))


def test_command_line(spark, tmp_path):
    from tripleloom import cli

    lines = [json.dumps({"iid": 5, "business summary": json.dumps({"summarization": "[['a','r','b']]"})}), "{broken"]
    out = str(tmp_path / "out")
    argv = ["--input_text_file_path", write(tmp_path / "in.jsonl", "\n".join(lines)), "--target-schema-path", write(tmp_path / "s.csv", "r,The subject entity r the object entity.\n"), "--output_dir", out]
    last = cli.main(argv, spark)[-1]
    spark.sparkContext.setLogLevel("ERROR")
    assert rows(last.results.select("iid", "triplets")) == [("5", [["a", "r", "b"]])]
    assert spark.read.json(f"{out}/rejects").first().line == "{broken"
    assert rows(spark.read.json(f"{out}/iter=0/canon_kg").select("iid")) == [("5",)]
    with pytest.raises(ValueError):
        cli.main([*argv[:-1], str(tmp_path / "other"), "--oie_llm", "unheard-of"], spark)


def test_models_and_embedders_by_name(spark, tmp_path):
    asked = spark.createDataFrame([("i", "a"), ("i", None)], "instructions string, input string")
    assert rows(providers.local_named("python:builtins:max").complete(asked).select("completion")) == [("i",), ("i",)]
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "i int, t string")
    import hashlib

    spark.createDataFrame([(hashlib.sha256(b"abc").hexdigest(), [1.0, 2.0])], "key string, vector array<float>").write.parquet(str(tmp_path / "v"))
    found = {r.i: r.vector for r in providers.embedder_named(spark, f"table:{tmp_path}/v")(df, "t").collect()}
    assert found == {1: [1.0, 2.0], 2: None, 3: None}
    assert len(providers.embedder_named(spark, "hash:7")(df, "t").where("i = 1").first().vector) == 7
    found = {r.i: r.vector for r in providers.encoding(lambda: (lambda texts: [[float(len(t)), 1.0] for t in texts]), "n")(df, "t").collect()}
    assert found == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    for name in ("no-such-package/model",):
        with pytest.raises(ValueError):
            providers.embedder_named(spark, name)
        with pytest.raises(ValueError):
            providers.local_named(name)


def test_a_worker_holds_one_model():
    providers.loaded("one", lambda: 1)
    assert providers.loaded("two", lambda: 2) == 2 and set(providers._LOADED) == {"two"}
    providers.release("two")


def test_single_files_and_an_embedder_for_retrieval(spark, tmp_path):
    docs = spark.createDataFrame([(0, "5", "[['a','r','b']]")], "doc_ord bigint, iid string, text string")
    schema = spark.createDataFrame([(0, "r", "it r", "file"), (1, "q", "it q", "file")], "ord bigint, relation string, definition string, origin string")
    out, m = str(tmp_path / "out"), models()
    m.retrieve = providers.hashed(5)
    passes = pipeline.run(docs, schema, Config(refinement_iterations=1, relation_top_k=2, output_dir=out, single_file=True), m, output=True)
    assert json.load(open(f"{out}/iter1/canon_kg.json")) == [{"iid": 5, "triplets": [["a", "r", "b"]]}]
    (trace,) = json.load(open(f"{out}/iter1/result_at_each_stage.json"))
    assert trace["item_id"] == 5 and trace["schema_canonicalizaiton"] == [["a", "r", "b"]] and "2. q: it q" in trace["relation_hint"]
    assert len(passes[1].schema.first().embedding) == 64


def test_model_names(spark, tmp_path):
    from tripleloom import cli

    spark.createDataFrame([("h", "c")], "prompt_hash string, completion string").write.parquet(str(tmp_path / "r"))
    assert isinstance(cli.model_named(spark, f"replay:{tmp_path}/r", Config(), None), providers.Replay)
    assert isinstance(cli.model_named(spark, "my-gpt", Config(enable_parallel_requests=True), None), providers.Remote)
