"""The whole way from documents to a graph: extract, define, canonicalise, and again with hints.

Each stage is a function from tables to tables. What a model said is written before it is read again.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.config import Config
from tripleloom.functions.parsers import definitions, parsed_entities, parsed_triples
from tripleloom.functions.text import listed, listed_lists, listed_set
from tripleloom.operators import canonicalize, groups, hints, providers, schema as vocabulary
from tripleloom.operators.prompts import fill, fill_constant
from tripleloom.sources import sinks
from tripleloom.sources.documents import read_template
from tripleloom.storage import merge_join, written

#: Templates of our own, used where a file named in the options is missing.
TEMPLATES = {
    "oie_instructions": "List the facts of the text as subject, relation, object.\nExamples:\n{few_shot_examples}",
    "oie_input": "Item: {item_id}\nText: {input_text}",
    "refined_oie_instructions": "List the facts of the text as subject, relation, object. Hints are given.\nExamples:\n{few_shot_examples}",
    "refined_oie_input": "Text: {input_text}\nEntities: {entities_hint}\nRelations:\n{relations_hint}",
    "sd_instructions": "Define each relation in a sentence.\nExamples:\n{few_shot_examples}",
    "sd_input": "Text: {text}\nTriples: {triples}\nRelations: {relations}",
    "sc_instructions": "Choose the relation that means the same, by its letter.",
    "sc_input": "Text: {input_text}\nTriple: {query_triplet}\nRelation: {query_relation}: {query_relation_definition}\nChoices:\n{choices}",
    "ee_instructions": "List the entities of the text.\nExamples:\n{few_shot_examples}",
    "ee_input": "Text: {input_text}",
    "em_instructions": "Merge the two lists of entities.",
    "em_input": "Text: {input_text}\nFirst: {entity_list_1}\nSecond: {entity_list_2}",
}

#: What is set apart for a document whose extraction prompt got no completion.
UNANSWERED = "no completion"


def template(cfg: Config, name: str) -> str:
    path = getattr(cfg, f"{name}_template_file_path")
    return read_template(path) if os.path.exists(path) else TEMPLATES[name]


def few_shot(cfg: Config, stage: str) -> str:
    path = getattr(cfg, f"{stage}_few_shot_example_file_path")
    return read_template(path) if os.path.exists(path) else ""


@dataclass
class Models:
    """The models of the stages; ``sc`` None verifies by the score alone, ``em`` None merges entities by rule, ``embed`` gives vectors of texts.

    ``retrieve`` gives the vectors by which relations are retrieved for a document, of its text and of definitions; None is ``embed`` again.
    """

    oie: providers.Model
    sd: providers.Model
    ee: providers.Model
    sc: providers.Model | None = None
    em: providers.Model | None = None
    embed: Callable = field(default_factory=providers.hashed)
    retrieve: Callable | None = None


@dataclass
class Pass:
    """The tables of one pass."""

    triples: DataFrame
    rejects: DataFrame
    definitions: DataFrame
    undefined: DataFrame
    canonical: DataFrame
    schema: DataFrame
    results: DataFrame
    trace: DataFrame


def extract(documents: DataFrame, hinted: DataFrame | None, cfg: Config, models: Models) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nested triples (doc_ord, triples), long triples with text, rejects) of documents; with hints if there are any."""
    kind = "oie" if hinted is None else "refined_oie"
    instructions = fill_constant(template(cfg, f"{kind}_instructions"), few_shot_examples=few_shot(cfg, kind))
    rows = documents if hinted is None else documents.join(hinted, "doc_ord", "left")
    entities = F.lit("") if hinted is None else F.coalesce(listed(F.col("entity_hint")), F.lit(""))
    relations = F.lit("") if hinted is None else F.coalesce("relation_hint", F.lit(""))
    prompt = fill(template(cfg, f"{kind}_input"), input_text=F.col("text"), entities_hint=entities, relations_hint=relations, item_id=F.col("iid"))
    asked = rows.select("doc_ord", "iid", "text", F.lit(instructions).alias("instructions"), prompt.alias("input"))
    answers = models.oie.complete(asked).select("doc_ord", "text", F.col("completion").isNull().alias("unanswered"), parsed_triples(F.col("completion"), cfg.strict_arity).alias("a"))
    kept = written(answers.select("doc_ord", "text", "a.triples", F.when(F.col("unanswered"), F.array(F.lit(UNANSWERED))).otherwise(F.col("a.rejects")).alias("rejects")), "oie")
    long = groups.long_triples(kept, keys=("doc_ord", "text"))
    return kept.select("doc_ord", "triples"), long, kept.select("doc_ord", F.explode("rejects").alias("reject"))


def define(documents: DataFrame, nested: DataFrame, triples: DataFrame, cfg: Config, models: Models) -> DataFrame:
    """(doc_ord, relation, definition) for the relations of each document."""
    instructions = fill_constant(template(cfg, "sd_instructions"), few_shot_examples=few_shot(cfg, "sd"))
    rows = merge_join(merge_join(documents, nested, "doc_ord"), groups.relations_of(triples), "doc_ord", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))
    prompt = fill(template(cfg, "sd_input"), text=F.col("text"), triples=listed_lists(F.col("triples")), relations=listed_set(F.col("relations")))
    asked = rows.select("doc_ord", "relations", F.lit(instructions).alias("instructions"), prompt.alias("input"))
    return written(definitions(models.sd.complete(asked), "completion", ["doc_ord"]), "definitions")


def canonical(triples: DataFrame, defined: DataFrame, schema: DataFrame, cfg: Config, models: Models) -> tuple[DataFrame, DataFrame]:
    """(triples with ``canon`` and ``candidates``, vocabulary after it)."""
    rows = vocabulary.with_definitions(triples, defined, cfg.normalize_relations)
    instructions = template(cfg, "sc_instructions")

    def decide(part: DataFrame, known: DataFrame) -> DataFrame:
        if models.sc is None:
            return canonicalize.closed(part, known, models.embed, canonicalize.threshold(cfg.threshold), cfg.top_k)
        return canonicalize.closed_by_model(part, known, models.embed, models.sc, instructions, template(cfg, "sc_input"), cfg.top_k, cfg.answer_parse)

    if not cfg.enrich_schema:
        return written(decide(rows, schema).drop("text"), "canonical"), schema
    if models.sc is None:
        out, grown = canonicalize.enriched(rows, schema, models.embed, cfg.threshold, cfg.batch_unit, cfg.top_k)
        best = F.when(F.col("score").isNotNull(), F.array(F.struct(F.col("canon").alias("relation"), F.lit(None).cast("string").alias("definition"), "score")))
        return written(out.withColumn("candidates", best), "canonical"), grown
    out, grown = canonicalize.enriched_in_order(rows, schema, decide, models.embed, cfg.batch_unit)
    return written(out, "canonical"), grown


def construct_hints(documents: DataFrame, before: Pass, schema: DataFrame, cfg: Config, models: Models) -> DataFrame:
    """(doc_ord, entity_hint, relation_hint) from the canonical triples of the pass before, the texts, and the vocabulary."""
    kept = before.canonical.where("canon IS NOT NULL").select("doc_ord", "pos", "s", F.col("canon").alias("p"), "o")
    if cfg.rectangle_guard:
        sets = groups.guarded_sets(groups.nested(kept).withColumnRenamed("triplets", "triples"))
    else:
        sets = groups.entities_of(kept).join(groups.relations_of(kept), "doc_ord", "full")
    none = F.array().cast("array<string>")
    rows = documents.join(sets, "doc_ord", "left").withColumn("entities", F.coalesce("entities", none)).withColumn("relations", F.coalesce("relations", none))

    instructions = fill_constant(template(cfg, "ee_instructions"), few_shot_examples=few_shot(cfg, "ee"))
    asked = rows.withColumns({"instructions": F.lit(instructions), "input": fill(template(cfg, "ee_input"), input_text=F.col("text"))})
    found = models.ee.complete(asked).withColumn("found", parsed_entities("completion")).drop("completion", "instructions", "input")
    if models.em is None:
        merged = found.withColumn("entity_hint", hints.merged_entities(F.col("found"), F.col("entities")))
    else:
        prompt = fill(template(cfg, "em_input"), input_text=F.col("text"), entity_list_1=listed(F.col("found")), entity_list_2=listed(F.col("entities")))
        merged = models.em.complete(found.withColumns({"instructions": F.lit(template(cfg, "em_instructions")), "input": prompt})).withColumn("entity_hint", parsed_entities("completion"))
    merged = written(merged.select("doc_ord", "entity_hint", "relations"), "hints")

    retrieve = models.retrieve or models.embed
    known = schema if models.retrieve is None else embedded(schema.drop("embedding"), retrieve)
    near = hints.retrieved(retrieve(documents.select("doc_ord", "text"), "text"), "vector", known, cfg.relation_top_k)
    joined = merged.join(near, "doc_ord", "left").select("doc_ord", "entity_hint", hints.united(F.col("relations"), F.col("retrieved"), cfg.relation_top_k).alias("relations"))
    examples = groups.numbered_examples(groups.examples_of(kept))
    text = hints.relation_hints(joined.select("doc_ord", "relations"), schema, examples, documents)
    return written(joined.select("doc_ord", "entity_hint").join(text, "doc_ord"), "hints")


def embedded(schema: DataFrame, embed: Callable) -> DataFrame:
    """The vocabulary with vectors of its definitions; those that have one keep it."""
    if "embedding" not in schema.columns:
        schema = schema.withColumn("embedding", F.lit(None).cast("array<float>"))
    new = embed(schema.where("embedding IS NULL").drop("embedding"), "definition").withColumnRenamed("vector", "embedding")
    return written(schema.where("embedding IS NOT NULL").unionByName(new.select(schema.columns)), "schema")


def run(documents: DataFrame, schema: DataFrame, cfg: Config, models: Models, output: bool = False) -> list[Pass]:
    """All passes over documents (doc_ord, iid, text), one more than ``cfg.refinement_iterations``; the last one's results are the graph.

    With ``output`` each pass writes its results and trace under ``cfg.output_dir``, which must not be there yet; with ``cfg.single_file`` also
    as one JSON array file each, under iter0 and so on. An empty vocabulary without
    enrichment leaves no triple; with enrichment it is built from what is found. Empty documents give empty records.
    """
    spark = documents.sparkSession
    if output:
        sinks.create_output(spark, cfg.output_dir)
    documents = written(documents.select("doc_ord", "iid", F.coalesce("text", F.lit("")).alias("text")), "documents")
    schema = embedded(schema, models.embed)
    passes: list[Pass] = []
    for i in range(cfg.refinement_iterations + 1):
        hinted = construct_hints(documents, passes[-1], schema, cfg, models) if passes else None
        nested, triples, rejects = extract(documents, hinted, cfg, models)
        defined = define(documents, nested, triples, cfg, models)
        out, schema = canonical(triples, defined, schema, cfg, models)
        kept = out.where("canon IS NOT NULL").select("doc_ord", "pos", "s", F.col("canon").alias("p"), "o")
        results = groups.results(documents, kept)
        empty = documents.select("doc_ord", F.lit(None).cast("array<string>").alias("entity_hint"), F.lit("").alias("relation_hint"))
        trace = sinks.trace_records(documents, empty if hinted is None else hinted, nested, defined, out)
        passes.append(Pass(triples.drop("text"), rejects, defined, vocabulary.undefined(triples, defined), out, schema, results, trace))
        if output:
            sinks.write_results(results, f"{cfg.output_dir}/iter={i}/canon_kg")
            sinks.write_trace(trace, f"{cfg.output_dir}/iter={i}/result_at_each_stage")
            if cfg.single_file:
                folder = f"{cfg.output_dir}/iter{i}"
                os.makedirs(folder)
                sinks.export_array(spark, f"{cfg.output_dir}/iter={i}/canon_kg", f"{folder}/canon_kg.json")
                sinks.export_array(spark, f"{cfg.output_dir}/iter={i}/result_at_each_stage", f"{folder}/result_at_each_stage.json", 4, True)
    return passes
