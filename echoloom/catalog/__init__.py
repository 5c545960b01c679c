"""Registered queries: each operator on the test tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("sources", "sinks", "contexts", "speech", "normalize", "qa", "evaluate", "scoring", "augment",
           "runs", "streaming", "build")


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(import_module(f"{__name__}.{module}"), name))
    return found


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


# Sizes and positions are 32-bit integers in Spark and 64-bit in DuckDB.
INTEGERS = {
    "py_strip": ["n"], "flatten_hypotheses": ["segments"], "synthesis_metadata": ["context_length"], "write_synthesis_metadata": ["context_length"],
    "normalize_array_field": ["starts"], "nested_get_set": ["words"], "zip_answers": ["n"],
    "answerable_only": ["answers"],
    "chunk_contexts": ["chunk", "start", "n"],
    "chunk_answer_spans": ["i", "chunk", "start", "start_position", "end_position"],
    "nbest_spans": ["rank", "start", "end"], "trim_null_answer": ["probabilities"],
    "score_answers": ["rank", "start", "end"], "match_length": ["i"], "snr_mix": ["i"], "signal_gain": ["i"],
    "peak_normalize": ["i"], "augment_log": ["n"], "synthesis_plan": ["context_length"],
}


def oracle_sql() -> dict[str, str]:
    found = _collect("ORACLE")
    for name, columns in INTEGERS.items():
        cast = ", ".join(f'"{c}"::int as "{c}"' for c in columns)
        found[name] = f"select * replace ({cast}) from ({found[name]}) typed"
    return found
