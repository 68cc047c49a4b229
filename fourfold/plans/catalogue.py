"""All queries outside the llm subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fourfold.plans import q_align, q_codec, q_files, q_linkage, q_model, q_phase, q_pileup

#: Modules with QUERIES (name -> function of session and folder) and ORACLES (name -> SQL).
MODULES = [q_pileup, q_linkage, q_model, q_codec, q_align, q_files, q_phase]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
