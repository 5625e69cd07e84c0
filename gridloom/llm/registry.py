"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib

MODULES = [
    "op01_sentencepiece",
    "op02_suffix_tree",
    "op03_skip_chain_crf",
    "op04_toxicity_cnn",
    "op05_cube_mix",
    "op06_chosen_path",
    "op07_ball_tree",
    "op08_direct_codes",
    "op09_label_shards",
    "op10_block_naming",
]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"gridloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"gridloom.llm.{m}").ORACLE.items()}
