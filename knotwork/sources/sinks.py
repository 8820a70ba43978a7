"""Labels to storage, and statistics to text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from knotwork.functions import summaries
from knotwork.operators import structure
from knotwork.plans.graphs import Graph


def write_labels(labels: DataFrame, path: str, mode: str = "error") -> None:
    """labels(id, component) as Parquet, laid out by component so that one can be read alone."""
    labels.repartitionByRange("component", "id").sortWithinPartitions("component", "id").write.mode(mode).parquet(path)


def graph_report(graph: Graph) -> str:
    r = structure.graph_stats(graph).first()
    return f"vertices {r['vertices']}\nedges {r['edges']}\ndegree average {r['avg_degree']:.2f}, smallest {r['min_degree']}, largest {r['max_degree']}"


def component_report(labels: DataFrame) -> str:
    r = summaries.component_size_stats(labels).first()
    return f"components {r['components']}\nsize average {r['avg_size']:.2f}, smallest {r['min_size']}, largest {r['max_size']}"
