"""Queries of the core and the SQL that says the same: name -> callable(spark, folder of tables), name -> text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.cli import definitions_by_rule
from tripleloom.config import Config
from tripleloom.functions import parsers
from tripleloom.functions.similarity import nearest
from tripleloom.functions.text import listed, listed_lists
from tripleloom.operators import canonicalize, groups, hints, prompts, providers, rejects, schema as vocabulary
from tripleloom.plans import pipeline
from tripleloom.sources import documents as sources, sinks
from tripleloom.storage import shared_path, table
from tripleloom.streaming import enrich

#: Score from which the queries' verifier accepts.
TAU = 0.2
#: A template of each kind, for the queries on prompts.
OIE_TEMPLATE = "Item {item_id}, hints {{none}}: {input_text}"
SD_TEMPLATE = "{text}\nTriples: {triples}\nRelations: {relations}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Inputs that several queries share, as tables and as common table expressions.


def _schema(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary.last_wins(table(spark, folder, "relation_schema"), ["embedding"])


def _examples(spark: SparkSession, folder: str) -> DataFrame:
    """The example index as triples; each example is a document of its own, so that places are unique."""
    rows = table(spark, folder, "relation_examples").where(F.size("triplet") == 3)
    return rows.select(F.col("example_id").alias("doc_ord"), F.lit(0).alias("pos"), F.col("triplet")[0].alias("s"), F.col("triplet")[1].alias("p"), F.col("triplet")[2].alias("o"))


def _defined(triples: DataFrame) -> DataFrame:
    """A rule for definitions that leaves some relations without one."""
    rule = F.concat(F.lit("The subject entity "), F.col("p"), F.lit(" the object entity."))
    return triples.withColumn("definition", F.when(F.length("p") % 2 == 0, rule))


def _kg(spark: SparkSession, folder: str) -> DataFrame:
    return groups.long_triples(table(spark, folder, "canon_kg").select("doc_ord", F.col("triplets").alias("triples")))


def _embed(spark: SparkSession, folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """Vectors of definitions, looked up in embeddings."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    many = vectors.count()
    return providers.looked_up(vectors, lambda d: F.pmod(F.length(d) * 31 + F.ascii(F.substring(d, 20, 1)) * 7, F.lit(many)).cast("bigint"))


_SCH = """sch AS (SELECT first AS ord, relation, definition, origin, embedding FROM (SELECT *, min(ord) OVER (PARTITION BY relation) AS first,
  row_number() OVER (PARTITION BY relation ORDER BY ord DESC) AS n FROM relation_schema WHERE relation IS NOT NULL) WHERE n = 1)"""
_RANKED = """scored AS (SELECT q.key, s.ord, s.relation, s.definition, round(list_inner_product(q.v::DOUBLE[], s.embedding::DOUBLE[]), 6) + 0.0 AS score FROM q, sch s WHERE q.v IS NOT NULL AND s.embedding IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS rank FROM scored)"""
_VECTORS = "q AS (SELECT vec_id AS key, embedding AS v FROM embeddings)"
_TOP = f"WITH {_SCH}, {_VECTORS}, {_RANKED}"
_EX = "ex AS (SELECT example_id AS doc_ord, triplet[1] AS s, triplet[2] AS p, triplet[3] AS o FROM relation_examples WHERE len(triplet) = 3)"
_DEF = "def AS (SELECT *, CASE WHEN length(p) % 2 = 0 THEN 'The subject entity ' || p || ' the object entity.' END AS definition FROM ex)"
_KEY = "(length({0}) * 31 + ascii(substr({0}, 20, 1)) * 7) % (SELECT count(*) FROM embeddings)"
_BEST = f"""q AS (SELECT DISTINCT d.definition AS key, e.embedding AS v FROM def d JOIN embeddings e ON e.vec_id = {_KEY.format("d.definition")}
  WHERE d.p NOT IN (SELECT relation FROM sch)), {_RANKED}, best AS (SELECT key, relation, score FROM ranked WHERE rank = 1)"""
_KG = "kg AS (SELECT doc_ord, i - 1 AS pos, triplets[i][1] AS s, triplets[i][2] AS p, triplets[i][3] AS o FROM (SELECT doc_ord, triplets, unnest(range(1, len(triplets) + 1)) AS i FROM canon_kg))"
_EDGE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_EDGE}|{_EDGE}$', '', 'g')"


def _quoted_sql(x: str) -> str:
    body = rf"replace(replace(replace(replace({x}, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')"
    return rf"""(CASE WHEN {x} IS NULL THEN 'None' WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || {body} || '"' ELSE '''' || replace({body}, '''', '\''') || '''' END)"""


def _listed_sql(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda x: {_quoted_sql('x')}), ', ') || ']'"


# Retrieval and verification.


@query(f"{_TOP} SELECT key AS vec_id, rank, relation, score FROM ranked WHERE rank <= 5")
def topk5_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The five relations of the vocabulary nearest to each vector."""
    s = _schema(spark, folder)
    top = nearest(table(spark, folder, "embeddings"), ["vec_id"], "embedding", s, 5)
    return top.join(F.broadcast(s.select("ord", "relation")), "ord").select("vec_id", "rank", "relation", "score")


@query(f"{_TOP} SELECT key AS vec_id, rank, relation, score FROM ranked WHERE rank <= 5")
def topk5_native(spark: SparkSession, folder: str) -> DataFrame:
    """The same by JVM expressions alone."""
    s = _schema(spark, folder)
    top = nearest(table(spark, folder, "embeddings"), ["vec_id"], "embedding", s, 5, "native")
    return top.join(F.broadcast(s.select("ord", "relation")), "ord").select("vec_id", "rank", "relation", "score")


@query(f"{_TOP} SELECT key AS doc_ord, string_agg(relation, '|' ORDER BY rank) AS retrieved FROM ranked WHERE rank <= 10 GROUP BY key")
def topk10_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """The ten relations nearest to each document's vector, as a list."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_ord"), "embedding")
    return hints.retrieved(rows, "embedding", _schema(spark, folder)).select("doc_ord", F.array_join("retrieved", "|").alias("retrieved"))


@query(f"{_TOP} SELECT key AS vec_id, CASE WHEN score >= {TAU} THEN relation END AS relation, CASE WHEN score >= {TAU} THEN score END AS score FROM ranked WHERE rank = 1")
def verify_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The relation that the rule verifier accepts for each vector, or null."""
    found = canonicalize.candidates(table(spark, folder, "embeddings"), ["vec_id"], "embedding", _schema(spark, folder))
    chosen = canonicalize.threshold(TAU)(F.col("candidates"))
    return found.select("vec_id", chosen["relation"].alias("relation"), chosen["score"].alias("score"))


@query(
    f"{_TOP} SELECT key AS vec_id, string_agg(chr((64 + rank)::INT) || '. ''' || relation || ''': ' || coalesce(definition, '') || chr(10), '' ORDER BY rank) || chr((65 + count(*))::INT) || '. None of the above.' || chr(10) AS choices "
    "FROM ranked WHERE rank <= 5 GROUP BY key"
)
def choice_block(spark: SparkSession, folder: str) -> DataFrame:
    """The choices that a verifier is asked to choose from."""
    found = canonicalize.candidates(table(spark, folder, "embeddings"), ["vec_id"], "embedding", _schema(spark, folder))
    return found.select("vec_id", prompts.choices(F.col("candidates")).alias("choices"))


_ANSWER = "CASE WHEN vec_id % 11 = 0 THEN '' WHEN vec_id % 7 = 0 THEN chr((65 + vec_id % 8)::INT) || '.' ELSE chr((65 + vec_id % 8)::INT) END"


@query(
    f"{_TOP}, a AS (SELECT vec_id, {_ANSWER} AS answer FROM embeddings) SELECT a.vec_id, x.relation AS exact, f.relation AS first_char FROM a "
    "LEFT JOIN ranked x ON x.key = a.vec_id AND x.rank <= 5 AND length(answer) = 1 AND x.rank = ascii(answer) - 64 LEFT JOIN ranked f ON f.key = a.vec_id AND f.rank <= 5 AND answer <> '' AND f.rank = ascii(answer) - 64"
)
def verifier_answers(spark: SparkSession, folder: str) -> DataFrame:
    """What a verifier's letter stands for, taken as a whole and by its first character."""
    found = canonicalize.candidates(table(spark, folder, "embeddings"), ["vec_id"], "embedding", _schema(spark, folder))
    letter = F.char(65 + F.col("vec_id") % 8)
    answer = F.when(F.col("vec_id") % 11 == 0, "").when(F.col("vec_id") % 7 == 0, F.concat(letter, F.lit("."))).otherwise(letter)
    pick = lambda mode: prompts.chosen(answer, F.col("candidates"), mode)["relation"]
    return found.select("vec_id", pick("exact").alias("exact"), pick("first_char").alias("first_char"))


# The vocabulary.


@query(f"WITH {_SCH} SELECT ord, relation, definition, origin FROM sch")
def schema_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary with each relation once."""
    return _schema(spark, folder).drop("embedding")


@query(f"WITH {_SCH}, {_EX} SELECT doc_ord, p FROM ex WHERE p IN (SELECT relation FROM sch)")
def schema_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    """Triples whose relation the vocabulary has as written."""
    return vocabulary.known(_examples(spark, folder), _schema(spark, folder)).select("doc_ord", "p")


@query(f"WITH {_SCH}, {_EX} SELECT doc_ord, p FROM ex WHERE NOT EXISTS (SELECT 1 FROM sch WHERE relation = p)")
def schema_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Triples whose relation it does not have."""
    return vocabulary.unknown(_examples(spark, folder), _schema(spark, folder)).select("doc_ord", "p")


@query(
    f"WITH {_SCH}, {_EX}, {_DEF}, new AS (SELECT p AS relation, coalesce(definition, p) AS definition, min(doc_ord) AS seen FROM def WHERE p IS NOT NULL AND p NOT IN (SELECT relation FROM sch) GROUP BY ALL) "
    "SELECT ord, relation, definition FROM sch UNION ALL SELECT (SELECT max(ord) FROM sch) + row_number() OVER (ORDER BY seen), relation, definition FROM new"
)
def schema_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary with all relations of the examples taken in, in order of first appearance."""
    s = _schema(spark, folder).drop("embedding")
    t = _defined(_examples(spark, folder)).where("p IS NOT NULL")
    new = t.groupBy(F.col("p").alias("relation")).agg(F.min_by(F.coalesce("definition", "p"), "doc_ord").alias("definition"), F.min("doc_ord").alias("at"))
    return vocabulary.upsert(s, new).select("ord", "relation", "definition")


# Canonicalisation.


@query(
    f"WITH {_SCH}, {_EX}, {_DEF}, {_BEST} SELECT d.doc_ord, path, CASE WHEN path = 'exact' THEN d.p WHEN path = 'verify' AND b.score >= {TAU} THEN b.relation END AS canon, CASE WHEN path = 'verify' THEN b.score END AS score "
    "FROM (SELECT *, CASE WHEN p IN (SELECT relation FROM sch) THEN 'exact' WHEN definition IS NULL THEN 'nodef' ELSE 'verify' END AS path FROM def) d LEFT JOIN best b ON b.key = d.definition"
)
def canonicalize_closed(spark: SparkSession, folder: str) -> DataFrame:
    """Triples brought to the vocabulary as it is."""
    out = canonicalize.closed(_defined(_examples(spark, folder)), _schema(spark, folder), _embed(spark, folder), canonicalize.threshold(TAU))
    return out.select("doc_ord", "path", "canon", F.try_element_at("candidates", F.lit(1))["score"].alias("score"))


def _enriched(spark: SparkSession, folder: str, unit: str) -> tuple[DataFrame, DataFrame]:
    return canonicalize.enriched(_defined(_examples(spark, folder)), _schema(spark, folder), _embed(spark, folder), TAU, unit)


_ENRICHED = f"""WITH {_SCH}, {_EX}, {_DEF}, {_BEST}, res AS (SELECT d.*, CASE WHEN p IN (SELECT relation FROM sch) THEN 'exact' WHEN definition IS NULL THEN 'nodef' ELSE 'verify' END AS path, b.relation AS near, b.score
  FROM def d LEFT JOIN best b ON b.key = d.definition AND b.score >= {TAU})"""


@query(f"{_ENRICHED} SELECT doc_ord, path, CASE WHEN path = 'verify' THEN coalesce(near, p) ELSE p END AS canon FROM res")
def canonicalize_enrich_all(spark: SparkSession, folder: str) -> DataFrame:
    """Triples brought to a vocabulary that takes in, at the end, what it refused."""
    return _enriched(spark, folder, "all")[0].select("doc_ord", "path", "canon")


@query(
    f"{_ENRICHED}, new AS (SELECT p AS relation, arg_min(coalesce(definition, p), doc_ord) AS definition, min(doc_ord) AS seen FROM res WHERE p IS NOT NULL AND (path = 'nodef' OR path = 'verify' AND near IS NULL) GROUP BY p) "
    "SELECT ord, relation, definition, origin FROM sch UNION ALL SELECT (SELECT max(ord) FROM sch) + row_number() OVER (ORDER BY seen), relation, definition, 'enriched' FROM new"
)
def enriched_schema_all(spark: SparkSession, folder: str) -> DataFrame:
    """That vocabulary."""
    return _enriched(spark, folder, "all")[1].drop("embedding")


def _growing(ctes: str) -> str:
    """SQL for growth from document to document: ``ctes`` end in one named t (doc_ord, pos, p, definition); gives marked (with path), best and voc.

    The vocabulary's history is folded over first appearances, one a step; joined holds the places of those that joined.
    """
    return f"""WITH RECURSIVE {_SCH}, {ctes},
firsts AS (SELECT p AS relation, definition, min({{'d': doc_ord, 'p': pos}}) AS at FROM t WHERE p IS NOT NULL AND p NOT IN (SELECT relation FROM sch) GROUP BY p, definition),
vec AS (SELECT f.relation, f.definition, f.at.d AS doc_ord, row_number() OVER (ORDER BY f.at) AS n, e.embedding::DOUBLE[] AS v FROM firsts f LEFT JOIN embeddings e ON e.vec_id = {_KEY.format("f.definition")}),
base AS (SELECT n, max(round(list_inner_product(v, s.embedding::DOUBLE[]), 6)) AS top FROM vec, sch s WHERE v IS NOT NULL AND s.embedding IS NOT NULL GROUP BY n),
near AS (SELECT a.n, list(b.n) AS js FROM vec a, vec b WHERE b.doc_ord < a.doc_ord AND a.v IS NOT NULL AND b.v IS NOT NULL AND round(list_inner_product(a.v, b.v), 6) >= {TAU} GROUP BY a.n),
steps AS (SELECT n, relation, coalesce(top >= {TAU}, false) AS taken, coalesce(js, []) AS js, list(relation) OVER (ORDER BY n) AS names FROM vec LEFT JOIN base USING (n) LEFT JOIN near USING (n)),
grow AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS joined UNION ALL
  SELECT s.n, CASE WHEN s.taken OR list_has_any(s.js, joined) OR list_contains(list_transform(joined, lambda j: names[j]), s.relation) THEN joined ELSE list_append(joined, s.n) END FROM grow g JOIN steps s ON s.n = g.n + 1),
new AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM vec WHERE n IN (SELECT unnest(joined) FROM (SELECT joined FROM grow ORDER BY n DESC LIMIT 1))),
voc AS (SELECT ord, relation, embedding::DOUBLE[] AS v, NULL::BIGINT AS since FROM sch UNION ALL SELECT (SELECT max(ord) FROM sch) + k, relation, v, doc_ord FROM new),
marked AS (SELECT t.*, CASE WHEN x.relation IS NOT NULL AND coalesce(x.since < t.doc_ord, true) THEN 'exact' WHEN definition IS NULL OR p IS NULL THEN 'nodef' ELSE 'verify' END AS path FROM t LEFT JOIN voc x ON x.relation = t.p),
scores AS (SELECT q.definition, c.relation, c.ord, c.since, round(list_inner_product(q.v, c.v), 6) + 0.0 AS score FROM (SELECT DISTINCT definition, v FROM vec WHERE v IS NOT NULL) q, voc c WHERE c.v IS NOT NULL AND round(list_inner_product(q.v, c.v), 6) >= {TAU}),
ranked AS (SELECT m.doc_ord, m.pos, c.relation, c.score, row_number() OVER (PARTITION BY m.doc_ord, m.pos ORDER BY score DESC, ord) AS n FROM marked m JOIN scores c ON c.definition = m.definition AND coalesce(c.since < m.doc_ord, true) WHERE path = 'verify'),
best AS (SELECT doc_ord, pos, relation, score FROM ranked WHERE n = 1)"""


_EX_GROWN = _growing(f"{_EX}, {_DEF}, t AS (SELECT doc_ord, 0 AS pos, p, definition FROM def)") + " SELECT m.doc_ord, m.pos, path, CASE WHEN path = 'exact' THEN p ELSE coalesce(b.relation, p) END AS canon, b.score FROM marked m LEFT JOIN best b USING (doc_ord, pos)"


@query(_EX_GROWN)
def canonicalize_enrich_doc(spark: SparkSession, folder: str) -> DataFrame:
    """Triples brought to a vocabulary that grows from document to document."""
    return _enriched(spark, folder, "document")[0].select("doc_ord", "pos", "path", "canon", "score")


@query(_EX_GROWN)  # each example is a document of one triple
def canonicalize_enrich_triple(spark: SparkSession, folder: str) -> DataFrame:
    """Triples brought to a vocabulary that grows from triple to triple."""
    return _enriched(spark, folder, "triple")[0].select("doc_ord", "pos", "path", "canon", "score")


@query(f"WITH {_KG} SELECT doc_ord, pos, s, upper(p) AS p, o FROM kg WHERE p IS NOT NULL")
def replace_relation(spark: SparkSession, folder: str) -> DataFrame:
    """Triples with another relation between the same subject and object."""
    return _kg(spark, folder).where("p IS NOT NULL").withColumn("p", F.upper("p"))


# Definitions.


def _definition_text(triples: DataFrame) -> DataFrame:
    """An answer with definitions for each document, with a key to skip and a repeated line."""
    line = F.concat(F.lit("  "), F.col("p"), F.lit(" : first of "), F.col("p"))
    again = F.concat(F.col("p"), F.lit(": "), F.col("p"), F.lit(" means: it "))
    lines = triples.where(F.col("p").isNotNull() & (F.length("p") % 2 == 0)).select("doc_ord", "pos", line.alias("a"), again.alias("b"))
    gathered = F.array_sort(F.collect_list(F.struct("pos", "a", "b")))
    body = F.flatten(F.transform(gathered, lambda x: F.array(x["a"], F.lit("no colon"), x["b"])))
    return lines.groupBy("doc_ord").agg(F.concat(F.lit("Answer: skipped\n"), F.array_join(body, "\n")).alias("completion"))


@query(f"WITH {_KG} SELECT doc_ord, pos, p, CASE WHEN length(p) % 2 = 0 THEN p || ' means: it' END AS definition FROM kg")
def definition_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each triple with the definition that its document's answer gives its relation."""
    t = _kg(spark, folder)
    d = parsers.definitions(_definition_text(t), "completion", ["doc_ord"])
    return vocabulary.with_definitions(t, d).select("doc_ord", "pos", "p", "definition")


@query(f"WITH {_KG} SELECT DISTINCT doc_ord, p AS relation FROM kg WHERE p IS NULL OR length(p) % 2 <> 0")
def undefined_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of a document that its answer does not define."""
    t = _kg(spark, folder)
    return vocabulary.undefined(t, parsers.definitions(_definition_text(t), "completion", ["doc_ord"]))


@query(
    rf"""WITH l AS (SELECT doc_id, i AS n, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
c AS (SELECT doc_id, n, {_strip_sql("substr(line, 1, instr(line, ':') - 1)")} AS relation, {_strip_sql("substr(line, instr(line, ':') + 1)")} AS definition FROM l WHERE contains(line, ':'))
SELECT doc_id, relation, arg_max(definition, n) AS definition FROM c WHERE relation <> 'Answer' GROUP BY doc_id, relation"""
)
def definitions_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The documents read as answers with definitions."""
    return parsers.definitions(table(spark, folder, "documents"), "text", ["doc_id"])


# Triples and entities in answers.


@query(f"WITH {_KG} SELECT doc_ord, row_number() OVER (PARTITION BY doc_ord ORDER BY pos) - 1 AS pos, s, p, o FROM kg WHERE s NOT IN ('', '_') AND p NOT IN ('', '_') AND o NOT IN ('', '_')")
def triples_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The triples written as a model would and read again."""
    answers = table(spark, folder, "canon_kg").select("doc_ord", listed_lists(F.col("triplets")).alias("completion"))
    parsed = answers.select("doc_ord", parsers.parsed_triples(F.col("completion"))["triples"].alias("triples"))
    return groups.long_triples(parsed)


@query(f"WITH {_KG} SELECT doc_ord, array_to_string(list_sort(list_distinct(list_concat(list(s), list(o)))), '|') AS entities FROM kg WHERE p IS NOT NULL GROUP BY doc_ord")
def entities_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The entities of a document written as a list in an answer and read again."""
    rows = groups.entities_of(_kg(spark, folder)).select("doc_ord", F.concat(F.lit("Entities: "), listed(F.col("entities")), F.lit(".")).alias("completion"))
    return rows.select("doc_ord", F.array_join(parsers.parsed_entities("completion"), "|").alias("entities"))


@query(f"SELECT example_id, {_listed_sql('triplet')} AS repr FROM relation_examples WHERE triplet IS NOT NULL")
def python_repr(spark: SparkSession, folder: str) -> DataFrame:
    """Triplets as Python list literals."""
    return table(spark, folder, "relation_examples").where("triplet IS NOT NULL").select("example_id", listed(F.col("triplet")).alias("repr"))


# Sets and results of documents.


@query(f"WITH {_KG} SELECT doc_ord, array_to_string(list_sort(list_distinct(list_concat(list(s), list(o)))), '|') AS entities FROM kg WHERE s IS NOT NULL OR o IS NOT NULL GROUP BY doc_ord")
def distinct_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects and objects of each document."""
    return groups.entities_of(_kg(spark, folder)).select("doc_ord", F.array_join("entities", "|").alias("entities"))


@query(f"WITH {_KG} SELECT doc_ord, coalesce(array_to_string(list_sort(list_distinct(list(p))), '|'), '') AS relations FROM kg GROUP BY doc_ord")
def distinct_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of each document."""
    return groups.relations_of(_kg(spark, folder)).select("doc_ord", F.array_join("relations", "|").alias("relations"))


_BAD = "triplets IS NULL OR len(triplets) = 0 OR len(list_filter(triplets, lambda t: t IS NULL OR len(t) <> 3)) > 0"


@query(
    f"SELECT doc_ord, CASE WHEN {_BAD} THEN '' ELSE array_to_string(list_sort(list_distinct(list_transform(triplets, lambda t: t[2]))), '|') END AS relations, "
    f"CASE WHEN {_BAD} THEN '' ELSE array_to_string(list_sort(list_distinct(list_concat(list_transform(triplets, lambda t: t[1]), list_transform(triplets, lambda t: t[3])))), '|') END AS entities FROM canon_kg"
)
def guarded_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The same sets by the rule that one malformed triple voids a document's."""
    rows = groups.guarded_sets(table(spark, folder, "canon_kg"), "triplets")
    return rows.select("doc_ord", F.array_join("relations", "|").alias("relations"), F.array_join("entities", "|").alias("entities"))


@query(f"WITH {_KG} SELECT doc_ord, pos, s, p, o FROM kg WHERE p IS NOT NULL")
def non_null_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """Triples that are not null."""
    return _kg(spark, folder).where("p IS NOT NULL")


@query(
    f"WITH {_KG}, j AS (SELECT doc_ord, string_agg(concat_ws('|', s, p, o), ';' ORDER BY pos) AS t FROM kg WHERE p IS NOT NULL GROUP BY doc_ord) "
    "SELECT doc_ord, coalesce(iid, doc_ord::VARCHAR) AS iid, coalesce(t, '') AS triplets FROM canon_kg LEFT JOIN j USING (doc_ord)"
)
def kg_result(spark: SparkSession, folder: str) -> DataFrame:
    """A result record for every document."""
    rows = groups.results(table(spark, folder, "canon_kg"), _kg(spark, folder))
    return rows.select("doc_ord", "iid", F.array_join(F.transform("triplets", lambda t: F.array_join(t, "|")), ";").alias("triplets"))


@query(f"WITH {_EX} SELECT relation, doc_ord, text FROM (SELECT p AS relation, ex.doc_ord, text, row_number() OVER (PARTITION BY p ORDER BY ex.doc_ord) AS n FROM ex JOIN relation_examples e ON e.example_id = ex.doc_ord WHERE p IS NOT NULL) WHERE n = 1")
def relation_example(spark: SparkSession, folder: str) -> DataFrame:
    """The first usage example of each relation in the corpus."""
    texts = table(spark, folder, "relation_examples").where(F.size("triplet") == 3)
    t = texts.select(F.col("example_id").alias("doc_ord"), F.lit(0).alias("pos"), F.col("triplet")[0].alias("s"), F.col("triplet")[1].alias("p"), F.col("triplet")[2].alias("o"), "text")
    return groups.first_examples(groups.examples_of(t)).select("relation", "doc_ord", "text")


_DRAWN = f"""numbered AS (SELECT p AS relation, doc_ord AS source, s, o, row_number() OVER (PARTITION BY p ORDER BY doc_ord % 1024, doc_ord) - 1 AS number, count(*) OVER (PARTITION BY p) AS many FROM ex WHERE p IS NOT NULL),
many AS (SELECT relation, max(many) AS many FROM numbered GROUP BY relation),
drawn AS (SELECT w.doc_ord, w.relation, x.source, x.s, x.o FROM (SELECT doc_ord, relation, ('0x' || md5('7|' || doc_ord || '|' || relation)[1:15])::BIGINT % many AS number FROM wanted JOIN many USING (relation)) w JOIN numbered x USING (relation, number))"""


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return groups.numbered_examples(groups.examples_of(_examples(spark, folder)))


@query(f"WITH {_EX}, {_KG}, wanted AS (SELECT DISTINCT doc_ord, p AS relation FROM kg WHERE p IS NOT NULL), {_DRAWN} SELECT doc_ord, relation, source FROM drawn")
def relation_example_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """For each document and each of its relations an example, drawn anew from all examples of the relation."""
    wanted = _kg(spark, folder).where("p IS NOT NULL").select("doc_ord", F.col("p").alias("relation"))
    return groups.drawn_examples(wanted, _numbered(spark, folder), 7).select("doc_ord", "relation", "source")


# Hints.


def _hinted(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_ord, relations): what each document had, then what its vector is near to."""
    had = groups.relations_of(_kg(spark, folder))
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    rows = had.withColumn("_v", F.pmod(F.col("doc_ord"), F.lit(vectors.count()))).join(vectors, "_v", "left")
    near = hints.retrieved(rows.select("doc_ord", "embedding"), "embedding", _schema(spark, folder))
    return had.join(near, "doc_ord", "left").select("doc_ord", hints.united(F.col("relations"), F.col("retrieved")).alias("relations"))


_HINTED = f"""WITH {_SCH}, {_KG}, had AS (SELECT doc_ord, coalesce(list_sort(list_distinct(list(p))), []) AS r FROM kg GROUP BY doc_ord),
q AS (SELECT doc_ord AS key, embedding AS v FROM had LEFT JOIN embeddings ON vec_id = doc_ord % (SELECT count(*) FROM embeddings)), {_RANKED},
near AS (SELECT key, list(relation ORDER BY rank) AS n FROM ranked WHERE rank <= 10 GROUP BY key),
hinted AS (SELECT doc_ord, list_concat(r, list_filter(coalesce(n, []), lambda x: NOT list_contains(r, x))[:10]) AS relations FROM had LEFT JOIN near ON key = doc_ord)"""


@query(f"{_HINTED} SELECT doc_ord, array_to_string(relations, '|') AS relations FROM hinted")
def hint_union(spark: SparkSession, folder: str) -> DataFrame:
    """Relations for the hint of each document."""
    return _hinted(spark, folder).select("doc_ord", F.array_join("relations", "|").alias("relations"))


@query(
    f"{_HINTED}, l AS (SELECT doc_ord, i, relations[i] AS relation FROM (SELECT doc_ord, relations, unnest(range(1, len(relations) + 1)) AS i FROM hinted)) "
    "SELECT h.doc_ord, coalesce(string_agg(i || '. ' || relation || ': ' || coalesce(definition, '') || chr(10), '' ORDER BY i), '') AS relation_hint FROM hinted h LEFT JOIN (l JOIN sch USING (relation)) USING (doc_ord) GROUP BY h.doc_ord"
)
def relation_hint_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each document's relation hint."""
    return hints.relation_hints(_hinted(spark, folder), _schema(spark, folder))


@query(
    f"{_HINTED}, l AS (SELECT doc_ord, i, relations[i] AS relation FROM (SELECT doc_ord, relations, unnest(range(1, len(relations) + 1)) AS i FROM hinted)), "
    f"{_EX}, wanted AS (SELECT doc_ord, relation FROM l JOIN sch USING (relation)), {_DRAWN}, "
    f"lines AS (SELECT l.doc_ord, i, i || '. ' || relation || ': ' || coalesce(definition, '') || chr(10) || CASE WHEN d.source IS NULL THEN '' ELSE 'For example, ' || {_listed_sql('[d.s, relation, d.o]')} || ' can be extracted from \"' || coalesce(e.text, '') || '\"' || chr(10) END AS line "
    "FROM l JOIN sch USING (relation) LEFT JOIN drawn d USING (doc_ord, relation) LEFT JOIN relation_examples e ON e.example_id = d.source) "
    "SELECT h.doc_ord, md5(coalesce(string_agg(line, '' ORDER BY i), '')) AS hint_md5 FROM hinted h LEFT JOIN lines USING (doc_ord) GROUP BY h.doc_ord"
)
def relation_hint_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each document's relation hint with an example for each relation, as a hash."""
    texts = table(spark, folder, "relation_examples").select(F.col("example_id").alias("doc_ord"), "text")
    rows = hints.relation_hints(_hinted(spark, folder), _schema(spark, folder), _numbered(spark, folder), texts, 7)
    return rows.select("doc_ord", F.md5("relation_hint").alias("hint_md5"))


@query(f"WITH {_KG}, e AS (SELECT doc_ord, list_distinct(list(o)) AS o, list_distinct(list(s)) AS s FROM kg WHERE s IS NOT NULL GROUP BY doc_ord) SELECT doc_ord, array_to_string(list_sort(list_distinct(list_concat(o, s))), '|') AS entity_hint FROM e")
def entity_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two lists of entities as one."""
    rows = _kg(spark, folder).where("s IS NOT NULL").groupBy("doc_ord").agg(F.collect_set("o").alias("a"), F.collect_set("s").alias("b"))
    return rows.select("doc_ord", F.array_join(F.array_sort(hints.merged_entities(F.col("a"), F.col("b"))), "|").alias("entity_hint"))


# Prompts.


@query("SELECT doc_id, 'Item ' || coalesce(iid, '') || ', hints {none}: ' || coalesce(text, '') AS prompt FROM documents")
def prompt_oie(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction prompts."""
    return table(spark, folder, "documents").select("doc_id", prompts.fill(OIE_TEMPLATE, item_id=F.col("iid"), input_text=F.col("text")).alias("prompt"))


@query(
    f"""WITH {_KG}, r AS (SELECT doc_ord, list_sort(list_distinct(list(p))) AS rs, list([s, p, o] ORDER BY pos) AS ts FROM kg WHERE p IS NOT NULL GROUP BY doc_ord)
SELECT doc_ord, '' || chr(10) || 'Triples: [' || array_to_string(list_transform(ts, lambda t: {_listed_sql("t")}), ', ') || ']' || chr(10) || 'Relations: ' || '{{' || array_to_string(list_transform(rs, lambda x: {_quoted_sql("x")}), ', ') || '}}' AS prompt FROM r"""
)
def prompt_sd(spark: SparkSession, folder: str) -> DataFrame:
    """Definition prompts, with the set of relations and the list of triples."""
    from tripleloom.functions.text import listed_set

    t = _kg(spark, folder).where("p IS NOT NULL")
    rows = groups.nested(t).join(groups.relations_of(t), "doc_ord")
    return rows.select("doc_ord", prompts.fill(SD_TEMPLATE, text=F.lit(""), triples=listed_lists(F.col("triplets")), relations=listed_set(F.col("relations"))).alias("prompt"))


@query("SELECT doc_id, role, content FROM (SELECT doc_id, 'system' AS role, 'Be brief.' AS content FROM documents UNION ALL SELECT doc_id, 'user', text FROM documents)")
def prompt_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts as chat messages."""
    return table(spark, folder, "documents").select("doc_id", F.inline(prompts.messages(F.lit("Be brief."), F.col("text"))))


@query("SELECT doc_id, sha256('Be brief.' || chr(0) || coalesce(text, '')) AS prompt_hash FROM documents")
def prompt_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys under which answers to prompts are recorded."""
    return table(spark, folder, "documents").select("doc_id", providers.prompt_hash(F.lit("Be brief."), F.col("text")).alias("prompt_hash"))


# Sources: tables are written to files in the shared folder and read as a user's files are.


def _file(spark: SparkSession, rows: DataFrame, order: list[str], line: Column, name: str) -> str:
    """The path of text files with a line for each row, in the order of some columns over files and lines."""
    path = shared_path(spark, name)
    rows.repartitionByRange(3, *order).sortWithinPartitions(*order).select(line.alias("value")).write.text(path)
    return path


_ONE_LINE = r"regexp_replace(coalesce({}, ''), '[\r\n]', ' ', 'g')"


def _one_line(c: str) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_ord, (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS iid, {_strip_sql(_ONE_LINE.format('text'))} AS text FROM documents")
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, a line each, read from plain text files: numbered over files, stripped, blank ones kept."""
    rows = table(spark, folder, "documents")
    path = _file(spark, rows, ["doc_id"], _one_line("text"), "texts")
    return sources.read_documents(spark, path)[0]


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsonl_nested(spark: SparkSession, folder: str) -> DataFrame:
    """A value inside of a column of JSON texts."""
    return table(spark, folder, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def _sniffed_sql(name: str, key: str, column: str) -> str:
    return (
        f"SELECT '{name}' AS name, count(*) AS n, count(*) FILTER (coalesce(json_type(TRY_CAST(x AS JSON)) = 'OBJECT', false)) AS objects, CASE WHEN json_type(TRY_CAST(arg_min(x, id) AS JSON)) = 'OBJECT' THEN 'jsonl' ELSE 'text' END AS kind "
        f"FROM (SELECT {key} AS id, {_ONE_LINE.format(column)} AS x FROM {name})"
    )


@query(_sniffed_sql("events", "event_id", "props") + " UNION ALL " + _sniffed_sql("documents", "doc_id", "text"))
def json_sniff(spark: SparkSession, folder: str) -> DataFrame:
    """What two files are taken for by their first line, and how many of their lines are JSON objects."""
    parts = []
    for name, key, column in (("events", "event_id", "props"), ("documents", "doc_id", "text")):
        path = _file(spark, table(spark, folder, name), [key], _one_line(column), name)
        counts = sources.numbered_lines(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(sources.is_json_object(F.col("line")).cast("bigint")).alias("objects"))
        parts.append(counts.select(F.lit(name).alias("name"), "n", "objects", F.lit(sources.sniff(spark, path)).alias("kind")))
    return parts[0].unionByName(parts[1])


def _strict_sql(x: str, numbers: bool = True) -> str:
    """SQL for JSON by the standard: DuckDB's JSON lets a trailing comma and, unless ``numbers``, NaN pass; what is left without the strings shows them."""
    lax = r",\s*[\]}]" + (r"|[nN][aA][nN]|[iI][nN][fF]" if numbers else "")
    return rf"""coalesce(json_valid({x}) AND NOT regexp_matches(regexp_replace({x}, '"(?:[^"\\]|\\.)*"', '""', 'g'), '{lax}'), false)"""


def _delivered(spark: SparkSession, folder: str) -> str:
    """A JSON lines file in all layouts: a first line, profile lines as delivered, documents with an id, and other objects."""
    part = lambda kind, df, key, line: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), line.alias("line"))
    rows = part(0, spark.range(1), "id", F.lit('{"id": "first", "text": "t"}'))
    rows = rows.unionByName(part(1, table(spark, folder, "item_profile_lines"), "line_id", _one_line("line")))
    rows = rows.unionByName(part(2, table(spark, folder, "documents"), "doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "text"))))
    rows = rows.unionByName(part(3, table(spark, folder, "events").where("props IS NOT NULL"), "event_id", _one_line("props")))
    return _file(spark, rows, ["kind", "id"], F.col("line"), "delivered")


_DELIVERED = rf"""WITH l AS (SELECT *, row_number() OVER (ORDER BY kind, id) - 1 AS doc_ord FROM (SELECT 0 AS kind, 0 AS id, NULL AS line, NULL AS text UNION ALL SELECT 1, line_id, {_ONE_LINE.format("line")}, NULL FROM item_profile_lines
  UNION ALL SELECT 2, doc_id, NULL, text FROM documents UNION ALL SELECT 3, event_id, {_ONE_LINE.format("props")}, NULL FROM events WHERE props IS NOT NULL)),
o AS (SELECT *, CASE WHEN {_strict_sql("line")} THEN TRY_CAST(line AS JSON) END AS doc, {_strict_sql("line", False)} AND json_type(TRY_CAST(line AS JSON)) = 'OBJECT' AS object FROM l),
v AS (SELECT *, CASE WHEN json_type(doc) = 'OBJECT' AND len(json_keys(doc)) = len(list_distinct(json_keys(doc))) THEN doc END AS one FROM o),
r AS (SELECT *, one ->> '$.iid' AS item, one ->> '$."business summary"' AS body FROM v),
i AS (SELECT *, CASE WHEN {_strict_sql("body")} THEN TRY_CAST(body AS JSON) END AS part FROM r)"""


@query(
    f"""{_DELIVERED} SELECT doc_ord, 'first' AS iid, 't' AS text FROM i WHERE kind = 0
UNION ALL SELECT doc_ord, CASE WHEN text IS NULL THEN doc_ord::VARCHAR ELSE id::VARCHAR END, coalesce(text, '{{"id":' || id || '}}') FROM i WHERE kind = 2
UNION ALL SELECT doc_ord, CASE WHEN item IS NULL OR body IS NULL THEN doc_ord::VARCHAR WHEN json_type(one, '$.iid') = 'DOUBLE' AND NOT regexp_matches(line, '"iid"\\s*:\\s*[-0-9.]+[eE]') THEN regexp_replace(item, '\\.0$', '') ELSE item END,
  CASE WHEN item IS NOT NULL AND body IS NOT NULL THEN CASE WHEN json_type(part) = 'OBJECT' AND len(json_keys(part)) = len(list_distinct(json_keys(part))) THEN coalesce(part ->> '$.summarization', '') ELSE '' END ELSE {_strip_sql("line")} END FROM i WHERE kind IN (1, 3) AND object"""
)
def jsonl_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read from JSON lines, whatever the layout of each line."""
    return sources.read_documents(spark, _delivered(spark, folder))[0]


@query(f"{_DELIVERED} SELECT doc_ord, line FROM i WHERE kind IN (1, 3) AND NOT coalesce(object, false)")
def jsonl_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of that file that are no JSON objects."""
    return sources.read_documents(spark, _delivered(spark, folder))[1]


@query("SELECT row_number() OVER (ORDER BY first) - 1 AS place, relation, definition FROM (SELECT min(ord) AS first, relation, arg_max({'d': nullif(definition, '')}, ord).d AS definition FROM relation_schema WHERE relation IS NOT NULL GROUP BY relation)")
def schema_file(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary written as a CSV file of two columns and read again, each relation at its first place with its last definition."""
    path = shared_path(spark, "schema")
    table(spark, folder, "relation_schema").coalesce(1).sortWithinPartitions("ord").select("relation", F.expr("nullif(definition, '')").alias("definition")).write.option("escape", '"').csv(path)
    found = sources.read_schema(spark, path)
    return found.select((F.row_number().over(Window.orderBy("ord")) - 1).alias("place"), "relation", "definition")


@query(f"WITH {_KG}, n AS (SELECT doc_ord, row_number() OVER (ORDER BY doc_ord) - 1 AS place FROM canon_kg) SELECT place, pos, s, p, o FROM kg JOIN n USING (doc_ord) WHERE p IS NOT NULL")
def literal_results(spark: SparkSession, folder: str) -> DataFrame:
    """The triples of earlier results, written a Python list for each line and read again."""
    none = F.array(*[F.lit(None).cast("string")] * 3)
    line = listed_lists(F.transform(F.coalesce("triplets", F.array().cast("array<array<string>>")), lambda t: F.coalesce(t, none)))
    path = _file(spark, table(spark, folder, "canon_kg"), ["doc_ord"], line, "results")
    found = sources.read_literal_results(spark, path)
    return groups.long_triples(found.select(F.col("doc_ord").alias("place"), F.col("triplets").alias("triples")), keys=("place",)).where("p IS NOT NULL")


@query(
    f"WITH {_KG}, j AS (SELECT doc_ord, string_agg(concat_ws('|', s, p, o), ';' ORDER BY pos) AS t FROM kg WHERE p IS NOT NULL GROUP BY doc_ord) "
    "SELECT row_number() OVER (ORDER BY doc_ord) - 1 AS place, coalesce(iid, doc_ord::VARCHAR) AS iid, coalesce(t, '') AS triplets FROM canon_kg LEFT JOIN j USING (doc_ord)"
)
def results_file(spark: SparkSession, folder: str) -> DataFrame:
    """Result records written as JSON lines in the order of documents and read again."""
    path = shared_path(spark, "records")
    sinks.write_results(groups.results(table(spark, folder, "canon_kg"), _kg(spark, folder)), path)
    rows = sources.numbered_lines(spark, path).select(F.col("doc_ord").alias("place"), F.from_json("line", "iid string, triplets array<array<string>>").alias("r"))
    return rows.select("place", "r.iid", F.array_join(F.transform("r.triplets", lambda t: F.array_join(t, "|")), ";").alias("triplets"))


# Whole runs.


def _run(spark: SparkSession, folder: str, **options) -> list[pipeline.Pass]:
    """A run over the result records written out as texts; the extracting model repeats the text of its prompt, vectors are looked up."""
    docs = table(spark, folder, "canon_kg").select("doc_ord", "iid", listed_lists(F.col("triplets")).alias("text"))
    echo = providers.Rules(lambda i, x: F.regexp_extract(x, r"(?s)Text: (.*?)(\nEntities: |$)", 1))
    models = pipeline.Models(oie=echo, sd=providers.Rules(definitions_by_rule), ee=echo, embed=_embed(spark, folder))
    return pipeline.run(docs, _schema(spark, folder), Config(threshold=TAU, **options), models)


def _flat(results: DataFrame) -> DataFrame:
    return results.select("doc_ord", "iid", F.array_join(F.transform("triplets", lambda t: F.array_join(t, "|")), ";").alias("triplets"))


#: What an echoing model extracts, and the definitions that the rule gives: to each relation that its prompt shows between single quotes and that holds no colon.
_RUN_T = rf"""{_KG}, ok AS (SELECT * FROM kg WHERE s NOT IN ('', '_') AND p NOT IN ('', '_') AND o NOT IN ('', '_')),
t AS (SELECT doc_ord, row_number() OVER (PARTITION BY doc_ord ORDER BY pos) - 1 AS pos, s, p, o, CASE WHEN p = {_strip_sql("p")} AND NOT regexp_matches(p, '[:''\\\n\r\t]') AND p <> 'Answer' THEN 'The subject entity ' || p || ' the object entity.' END AS definition FROM ok)"""
_RUN_Q = f"""q AS (SELECT DISTINCT t.definition AS key, e.embedding AS v FROM t JOIN embeddings e ON e.vec_id = {_KEY.format("t.definition")} WHERE t.p NOT IN (SELECT relation FROM sch)), {_RANKED}"""
_RUN = f"""WITH {_SCH}, {_RUN_T}, {_RUN_Q}, res AS (SELECT t.*, CASE WHEN p IN (SELECT relation FROM sch) THEN p ELSE b.relation END AS canon FROM t LEFT JOIN ranked b ON b.key = t.definition AND b.rank = 1 AND b.score >= {TAU})"""
_FLAT = """, j AS (SELECT doc_ord, string_agg(concat_ws('|', s, canon, o), ';' ORDER BY pos) AS ts FROM res WHERE canon IS NOT NULL GROUP BY doc_ord)
SELECT doc_ord, coalesce(iid, doc_ord::VARCHAR) AS iid, coalesce(ts, '') AS triplets FROM canon_kg LEFT JOIN j USING (doc_ord)"""


@query(_RUN + _FLAT)
def pipeline_run(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of one pass with a fixed vocabulary."""
    return _flat(_run(spark, folder)[-1].results)


@query(
    _growing(_RUN_T) + f""", again AS (SELECT m.*, c.relation AS near, row_number() OVER (PARTITION BY m.doc_ord, m.pos ORDER BY c.score DESC, c.ord) AS n FROM marked m LEFT JOIN scores c ON c.definition = m.definition),
res AS (SELECT doc_ord, pos, s, o, CASE WHEN p IN (SELECT relation FROM voc) THEN p ELSE coalesce(near, p) END AS canon FROM again WHERE n = 1)""" + _FLAT
)
def refine_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    """The graph of two passes with a vocabulary that grows; the second begins with what the first left."""
    return _flat(_run(spark, folder, refinement_iterations=1, enrich_schema=True)[-1].results)


@query(
    f"""{_RUN}, five AS (SELECT key, string_agg(relation || ':' || round(score * 1000000)::BIGINT, ',' ORDER BY rank) AS cs FROM ranked WHERE rank <= 5 GROUP BY key),
each AS (SELECT doc_ord, string_agg(concat_ws('|', s, p, o), ';' ORDER BY pos) AS oie, string_agg(coalesce(cs, ''), ';' ORDER BY pos) AS candidates, string_agg(CASE WHEN canon IS NULL THEN 'None' ELSE concat_ws('|', s, canon, o) END, ';' ORDER BY pos) AS canonical
  FROM res LEFT JOIN five ON five.key = res.definition AND p NOT IN (SELECT relation FROM sch) GROUP BY doc_ord),
maps AS (SELECT doc_ord, string_agg(p || '=' || definition, ';' ORDER BY p) AS defined FROM (SELECT DISTINCT doc_ord, p, definition FROM res WHERE definition IS NOT NULL) GROUP BY doc_ord)
SELECT doc_ord AS index, coalesce(iid, doc_ord::VARCHAR) AS item_id, coalesce('[' || array_to_string(list_transform(triplets, lambda t: CASE WHEN t IS NULL THEN 'None' ELSE {_listed_sql("t")} END), ', ') || ']', '') AS input_text, '' AS relation_hint, coalesce(oie, '') AS oie, coalesce(defined, '') AS schema_definition,
  coalesce(candidates, '') AS canonicalization_candidates, coalesce(canonical, '') AS schema_canonicalizaiton FROM canon_kg LEFT JOIN each USING (doc_ord) LEFT JOIN maps USING (doc_ord)"""
)
def stage_trace(spark: SparkSession, folder: str) -> DataFrame:
    """The trace of one pass, its nested fields as texts."""
    joined = lambda c: F.array_join(F.transform(c, lambda t: F.coalesce(F.array_join(t, "|"), F.lit("None"))), ";")
    five = F.transform("canonicalization_candidates", lambda x: F.array_join(F.transform(x, lambda c: F.concat(c["relation"], F.lit(":"), F.round(c["score"] * 1_000_000).cast("bigint").cast("string"))), ","))
    defined = F.transform(F.array_sort(F.map_entries("schema_definition")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return _run(spark, folder)[-1].trace.select(
        "index", "item_id", "input_text", "relation_hint", joined("oie").alias("oie"), F.array_join(defined, ";").alias("schema_definition"), F.array_join(five, ";").alias("canonicalization_candidates"), joined("schema_canonicalizaiton").alias("schema_canonicalizaiton")
    )


@query("SELECT event_type, min(ts) AS first_at FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def stream_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """When each type of event was first seen, kept by a stream."""
    source = table(spark, folder, "events").schema
    stream = spark.readStream.schema(source).parquet(f"{folder}/events.parquet*")
    target, kept = shared_path(spark, "seen"), shared_path(spark, "stream")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    enrich.first_seen(stream, "event_type", "ts").writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(target)
    return updates.groupBy("event_type").agg(F.min("first_at").alias("first_at"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, min(ts) AS first_at FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL")
def windowed_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each type on each day."""
    return enrich.first_seen(table(spark, folder, "events"), "event_type", "ts", window="1 day")


@query(
    _growing(f"{_KG}, t AS (SELECT *, CASE WHEN length(p) % 2 = 0 THEN 'The subject entity ' || p || ' the object entity.' END AS definition FROM kg)")
    + " SELECT m.doc_ord, m.pos, path, CASE WHEN path = 'exact' THEN p ELSE coalesce(b.relation, p) END AS canon FROM marked m LEFT JOIN best b USING (doc_ord, pos)"
)
def stream_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of a stream brought to a vocabulary that grows with it."""
    source = table(spark, folder, "canon_kg").schema
    stream = spark.readStream.schema(source).parquet(f"{folder}/canon_kg.parquet*")
    t = _defined(groups.long_triples(stream.select("doc_ord", F.col("triplets").alias("triples"))))
    known = enrich.Vocabulary(_schema(spark, folder))
    target = shared_path(spark, "stream-out")
    enrich.enrich_stream(t, known, _embed(spark, folder), TAU, target, shared_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(target).select("doc_ord", "pos", "path", "canon")


# Problem 4.


_LINES = rf"""WITH l AS (SELECT line_id, CASE WHEN {_strict_sql("line")} THEN TRY_CAST(line AS JSON) END AS doc FROM item_profile_lines),
m AS (SELECT *, coalesce(json_type(doc) = 'OBJECT' AND list_sort(json_keys(doc)) = ['business summary', 'iid'], false) AS fields, CASE WHEN json_type(doc, '$.iid') = 'UBIGINT' THEN TRY_CAST(doc ->> '$.iid' AS BIGINT) END AS iid,
  CASE WHEN json_type(doc, '$."business summary"') = 'VARCHAR' THEN doc ->> '$."business summary"' END AS body FROM l),
i AS (SELECT *, CASE WHEN {_strict_sql("body")} THEN TRY_CAST(body AS JSON) END AS part FROM m),
t AS (SELECT *, CASE WHEN json_type(part) = 'OBJECT' AND len(list_filter(json_keys(part), lambda x: x = 'summarization')) = 1 AND json_type(part, '$.summarization') = 'VARCHAR' THEN part ->> '$.summarization' END AS summarization FROM i),
r AS (SELECT line_id, iid, summarization, CASE WHEN doc IS NULL THEN 'bad_json' WHEN NOT fields THEN 'wrong_fields' WHEN iid IS NULL THEN 'bad_iid' WHEN summarization IS NULL OR regexp_full_match(summarization, '[\s\x0B\x1C-\x1F\x{{85}}\x{{200B}}\p{{Z}}]*') THEN 'bad_summary' END AS reason FROM t)"""


@query(f"{_LINES} SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of item_profile_lines that fail, each with its reason."""
    return rejects.rejected(table(spark, folder, "item_profile_lines"))


@query(f"{_LINES} SELECT line_id, iid, summarization FROM r WHERE reason IS NULL")
def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines of item_profile_lines with typed values."""
    return rejects.loaded(table(spark, folder, "item_profile_lines"))


@query()
def p4_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines have each outcome, are in a reject table, and came out otherwise after the exact check."""
    return rejects.audit(table(spark, folder, "item_profile_lines"))
