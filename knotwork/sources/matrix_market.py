"""Matrix Market coordinate text as a graph source and sink.

Comments (``%``) and blank lines may stand before the line of dimensions only.  It declares
rows, columns and entries; there are max(rows, columns) vertices, and exactly that many lines
are read as entries: two 1-based ids and an optional value, which is dropped.  Fewer lines, a
line that is no entry, and an id out of range fail the whole read; surplus lines are ignored.
The word ``symmetric`` in the first line is reported and changes nothing.

Lines are numbered without collecting them: one pass counts each input partition's lines and finds
the line of dimensions, a second one checks the entries; only a row a partition comes to the driver.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.plans.graphs import Graph, vertex_range


log = logging.getLogger(__name__)


class BadFile(ValueError):
    """The file is no coordinate file."""


@dataclass
class Header:
    vertices: int
    entries: int
    square: bool
    symmetric: bool


_ENTRY = r"^\s*([+-]?\d+)\s+([+-]?\d+)(\D.*)?$"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(value, part, at): lines of the file with their partition and place in it, in file order."""
    order = F.monotonically_increasing_id()
    return spark.read.text(path).select("value", order.alias("order")).select("value", F.shiftright("order", 33).alias("part"), F.col("order").bitwiseAND((1 << 33) - 1).alias("at"))


def scan(spark: SparkSession, path: str) -> tuple[Header, DataFrame]:
    """The header and the file's entries as edges (src, dst) from 0, loops and repeats included."""
    line = F.struct("at", "value")
    content = ~F.col("value").rlike(r"^\s*$") & ~F.startswith("value", F.lit("%"))
    try:
        lines = _numbered(spark, path)
        parts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first"), F.min(F.when(content, line)).alias("dims")).orderBy("part").collect()  # a row a partition
    except Exception as e:  # Spark reports a missing path when the plan is made or run
        raise BadFile(f"cannot read {path}: {e}") from e
    head = next((r for r in parts if r["dims"] is not None), None)
    if head is None:
        raise BadFile(f"{path}: no line of dimensions")
    numbers = head["dims"]["value"].split()
    try:
        rows, cols, entries = (int(x) for x in numbers[:3])
    except ValueError as e:
        raise BadFile(f"{path}: no three dimensions in {head['dims']['value']!r}") from e
    header = Header(max(rows, cols), entries, rows == cols, "symmetric" in parts[0]["first"]["value"].lower())
    if header.vertices <= 0 or entries < 0:
        raise BadFile(f"{path}: dimensions out of range")
    if not header.square:
        log.warning("%s: %d rows and %d columns; the graph has %d vertices", path, rows, cols, header.vertices)
    bases, total = [], 0
    for r in parts:
        if r["part"] >= head["part"]:
            skipped = head["dims"]["at"] + 1 if r["part"] == head["part"] else r["first"]["at"]
            bases.append((r["part"], total - skipped))
            total += r["n"] - (skipped - r["first"]["at"])
    if total < entries:
        raise BadFile(f"{path}: {total} entries of {entries}")
    base = spark.createDataFrame(bases, "part long, base long")
    numbered = lines.join(F.broadcast(base), "part").withColumn("nth", F.col("at") + F.col("base")).where(F.col("nth").between(0, entries - 1))
    ids = [F.expr(f"try_cast(regexp_extract(value, r'{_ENTRY}', {i}) AS BIGINT)") for i in (1, 2)]
    edges = numbered.select((ids[0] - 1).alias("src"), (ids[1] - 1).alias("dst"), "nth")
    ok = F.col("src").between(0, header.vertices - 1) & F.col("dst").between(0, header.vertices - 1)
    bad = edges.agg(F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col("nth"))).alias("n")).first()["n"]
    if bad is not None:
        raise BadFile(f"{path}: entry {bad + 1} is malformed or out of range")
    return header, edges.select("src", "dst")


def read(spark: SparkSession, path: str) -> Graph:
    """The file as a graph: loops dropped, repeated entries kept."""
    header, edges = scan(spark, path)
    return Graph(vertex_range(spark, header.vertices), edges.where("src <> dst"))


def write(graph: Graph, vertices: int, path: str, comments: tuple[str, ...] = ()) -> None:
    """Write edges as one coordinate file (a single task writes it, as the format is one file)."""
    edges = graph.edges
    count = edges.count()
    lines = ["%%MatrixMarket matrix coordinate pattern symmetric", *[f"% {c}" for c in comments], f"{vertices} {vertices} {count}"]
    head = edges.sparkSession.createDataFrame(list(enumerate(lines)), "o int, value string")
    body = edges.select(F.lit(len(lines)).alias("o"), F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string")).alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("o").select("value").write.text(path)
