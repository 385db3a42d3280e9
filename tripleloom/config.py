"""Options of a pipeline run, and their command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Names and defaults are those users of such pipelines know; paths are relative to the working folder.

    Beyond them: ``batch_unit`` says what sees the vocabulary grow (triple, document, all), ``answer_parse`` how a verifier's letter is read
    (exact, first_char), ``strict_arity`` whether triples that do not have three parts are set apart, ``rectangle_guard`` whether one such
    triple voids the hints of its document, ``normalize_relations`` whether relations are stripped before a definition is looked up,
    ``threshold`` the score from which the rule verifier accepts, ``top_k`` the candidates of a triple, ``relation_top_k`` those of a document,
    ``single_file`` whether results and trace are also written as one JSON array file each.
    """

    oie_llm: str = "rules"
    oie_instructions_template_file_path: str = "prompt_templates/oie_instructions_template.txt"
    oie_input_template_file_path: str = "prompt_templates/oie_input_template.txt"
    oie_few_shot_example_file_path: str = "few_shot_examples/example/oie_few_shot_examples.txt"
    sd_llm: str = "rules"
    sd_instructions_template_file_path: str = "prompt_templates/sd_instructions_template.txt"
    sd_input_template_file_path: str = "prompt_templates/sd_input_template.txt"
    sd_few_shot_example_file_path: str = "few_shot_examples/example/sd_few_shot_examples.txt"
    sc_llm: str = "rules"
    sc_embedder: str = "hash"
    sc_instructions_template_file_path: str = "prompt_templates/sc_instructions_template.txt"
    sc_input_template_file_path: str = "prompt_templates/sc_input_template.txt"
    sr_adapter_path: str | None = None
    sr_embedder: str = "hash"
    refined_oie_instructions_template_file_path: str = "prompt_templates/oie_r_instructions_template.txt"
    refined_oie_input_template_file_path: str = "prompt_templates/oie_r_input_template.txt"
    refined_oie_few_shot_example_file_path: str = "few_shot_examples/example/r_oie_few_shot_examples.txt"
    ee_llm: str = "rules"
    ee_instructions_template_file_path: str = "prompt_templates/ee_instructions_template.txt"
    ee_input_template_file_path: str = "prompt_templates/ee_input_template.txt"
    ee_few_shot_example_file_path: str = "few_shot_examples/example/ee_few_shot_examples.txt"
    em_instructions_template_file_path: str = "prompt_templates/em_instructions_template.txt"
    em_input_template_file_path: str = "prompt_templates/em_input_template.txt"
    input_text_file_path: str = "datasets/example.txt"
    target_schema_path: str = ""
    output_dir: str = "output/tmp"
    refinement_iterations: int = 0
    enrich_schema: bool = False
    enable_parallel_requests: bool = False
    log_level: str = "info"
    batch_unit: str = "document"
    answer_parse: str = "exact"
    strict_arity: bool = True
    rectangle_guard: bool = False
    normalize_relations: bool = False
    threshold: float = 0.5
    top_k: int = 5
    relation_top_k: int = 10
    single_file: bool = False

    def __post_init__(self):
        if self.batch_unit not in ("triple", "document", "all"):
            raise ValueError(f"batch_unit: {self.batch_unit}")
        if self.answer_parse not in ("exact", "first_char"):
            raise ValueError(f"answer_parse: {self.answer_parse}")
        if self.log_level not in ("debug", "info", "warning", "error"):
            raise ValueError(f"log_level: {self.log_level}")

    def models(self) -> set[str]:
        """The distinct models that a run needs."""
        return {self.oie_llm, self.sd_llm, self.sc_llm} | ({self.ee_llm} if self.refinement_iterations else set())


def is_remote(model: str) -> bool:
    """Whether a model name routes to a remote endpoint."""
    return "gpt" in model.lower()


def parse_args(argv: list[str] | None = None) -> Config:
    """Config from a command line; each option may be spelt with dashes or underscores, a flag stands alone or takes true or false."""
    parser = argparse.ArgumentParser()
    for f in fields(Config):
        names = list(dict.fromkeys((f"--{f.name}", f"--{f.name.replace('_', '-')}")))
        kind = type(f.default) if f.default is not None else str
        if kind is bool:
            parser.add_argument(*names, dest=f.name, nargs="?", const=True, default=f.default, type=lambda x: x.lower() in ("1", "true", "yes"))
        else:
            parser.add_argument(*names, dest=f.name, default=f.default, type=kind)
    return Config(**vars(parser.parse_args(argv)))
