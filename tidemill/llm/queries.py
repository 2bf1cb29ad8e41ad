"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold ``QUERIES`` and ``SQL``.
MODULES = ("q_mixing", "q_tokens", "q_quality", "q_toxicity", "q_near_dups", "q_decontaminate", "q_repeats", "q_line_dedup", "q_secrets", "q_pii", "q_simhash", "q_alignment", "q_phrases")


def queries() -> dict:
    found = {name: f for module in MODULES for name, f in import_module(f"tidemill.llm.{module}").QUERIES.items()}
    return found | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in import_module(f"tidemill.llm.{module}").SQL.items()}
