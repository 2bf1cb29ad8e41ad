"""All registered queries of the market operators and their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

#: Modules of ``tidemill.plans`` that hold ``QUERIES`` and ``SQL``.
MODULES = ("p_tape", "p_prep", "p_ladder", "p_decisions", "p_more", "p_streams", "p_loop", "p_sessions", "p_fits", "p_trailing", "p_meta", "p_tables")


def queries() -> dict:
    return {name: f for module in MODULES for name, f in import_module(f"tidemill.plans.{module}").QUERIES.items()}


def _no_minus_zero(sql: str) -> str:
    """sql with 0.0 added to its rounded columns: DuckDB rounds to -0.0 where Spark has 0.0."""
    out, at = [], 0
    while (end := sql.find(") AS ", at)) >= 0:
        depth, k = 0, end
        while k >= 0:
            depth += (sql[k] == ")") - (sql[k] == "(")
            if not depth:
                break
            k -= 1
        out += [sql[at : end + 1], " + 0.0" if sql[max(0, k - 5) : k] == "round" else ""]
        at = end + 1
    return "".join([*out, sql[at:]])


def oracle_sql() -> dict:
    return {name: _no_minus_zero(sql) for module in MODULES for name, sql in import_module(f"tidemill.plans.{module}").SQL.items()}
