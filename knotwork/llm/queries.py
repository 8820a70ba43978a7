"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import lattice, near_dup, neighbours, preferences, queries_map, queries_pairs, queries_scan, repeats, secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": queries_pairs.op1_repeats,
    "op10_preferences": queries_scan.op10_preferences,
    "op2_mixing": queries_scan.op2_mixing,
    "op3_near_dup": queries_pairs.op3_near_dup,
    "op4_secret_scan": queries_scan.op4_secret_scan,
    "op5_neighbours": queries_pairs.op5_neighbours,
    "op6_language_id": queries_map.op6_language_id,
    "op7_lattice": queries_pairs.op7_lattice,
    "op8_pieces": queries_map.op8_pieces,
    "op9_toxicity": queries_map.op9_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_repeats": repeats.oracle(),
    "op10_preferences": preferences.oracle(),
    "op3_near_dup": near_dup.oracle(2),
    "op4_secret_scan": secret_scan.oracle(),
    "op5_neighbours": neighbours.oracle(),
    "op7_lattice": lattice.oracle(),
}
