"""Running the pipeline from a command line: ``python -m tripleloom --input_text_file_path texts.jsonl --output_dir out ...``."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tripleloom.config import Config, is_remote, parse_args
from tripleloom.operators import providers
from tripleloom.plans import pipeline
from tripleloom.sources.documents import read_documents, read_schema

#: Where a remote model is asked unless TRIPLELOOM_URL says otherwise.
URL = "https://api.openai.com/v1/chat/completions"


def model_named(spark: SparkSession, name: str, cfg: Config, rule) -> providers.Model:
    """The model that a name in the options stands for.

    ``rules`` is the stage's own rule; ``replay:PATH`` reads recorded answers (prompt_hash, completion) from a Parquet table; a name that holds
    "gpt" is a remote model, asked one prompt at a time for each task unless parallel requests are on. Others run inside the workers.
    """
    if name == "rules":
        return providers.Rules(rule)
    if name.startswith("replay:"):
        return providers.Replay(spark.read.parquet(name.removeprefix("replay:")))
    if is_remote(name):
        tasks = spark.sparkContext.defaultParallelism
        return providers.Remote(providers.http_chat(os.environ.get("TRIPLELOOM_URL", URL), name), concurrency=100 if cfg.enable_parallel_requests else tasks, tasks=tasks)
    return providers.local_named(name)


def definitions_by_rule(instructions, text):
    """A definition for each relation that a prompt of our own template names."""
    names = F.regexp_extract_all(F.substring_index(text, "Relations: ", -1), F.lit("'([^']*)'"), F.lit(1))
    return F.array_join(F.transform(names, lambda r: F.concat(r, F.lit(": The subject entity "), r, F.lit(" the object entity."))), "\n")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[pipeline.Pass]:
    cfg = parse_args(argv)
    spark = spark or SparkSession.builder.appName("tripleloom").getOrCreate()
    spark.sparkContext.setLogLevel({"debug": "INFO", "info": "WARN", "warning": "WARN", "error": "ERROR"}[cfg.log_level])
    documents, rejects = read_documents(spark, cfg.input_text_file_path)
    schema = read_schema(spark, cfg.target_schema_path)
    echo = lambda instructions, text: F.regexp_extract(text, r"(?s)Text: (.*?)(\nEntities: |$)", 1)
    models = pipeline.Models(
        oie=model_named(spark, cfg.oie_llm, cfg, echo), sd=model_named(spark, cfg.sd_llm, cfg, definitions_by_rule), ee=model_named(spark, cfg.ee_llm, cfg, echo),
        sc=None if cfg.sc_llm == "rules" else model_named(spark, cfg.sc_llm, cfg, None), em=None if cfg.ee_llm == "rules" else model_named(spark, cfg.ee_llm, cfg, None),
        embed=providers.embedder_named(spark, cfg.sc_embedder), retrieve=None if (cfg.sr_embedder, cfg.sr_adapter_path) == (cfg.sc_embedder, None) else providers.embedder_named(spark, cfg.sr_embedder, cfg.sr_adapter_path),
    )
    passes = pipeline.run(documents, schema, cfg, models, output=True)
    if not rejects.isEmpty():
        rejects.write.mode("errorifexists").json(f"{cfg.output_dir}/rejects")
    return passes
