"""Connected components of a link table as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import saved

#: A step of a round runs in as many tasks as give each about this many links: small tables aren't dealt out in tiny files.
TASK_LINKS = 1 << 18
BATCH_ROWS = 1 << 16


def _values(column: pa.Array) -> list:
    """The nodes of a column as values that can be compared: numbers, or tuples of a struct's fields."""
    return [tuple(x.values()) for x in column.to_pylist()] if pa.types.is_struct(column.type) else column.to_pylist()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task contracted: every node but the smallest of its component among them, with that smallest node."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(_values(batch.column(0)), _values(batch.column(1))):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    for at in range(0, len(nodes), BATCH_ROWS):
        part = nodes[at : at + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], names=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of links(a, b).

    Tasks of TASK_LINKS links first contract their own links to stars. Where that took more than one task, alternating large-star and small-star
    steps join the stars; each round is written to the shared folder. The number of rounds grows with the logarithm of the longest path. No links
    give no rows; loops and repeated links do no harm. Nodes are numbers or structs of them; the
    fields before one that can be null tell whether it is.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = _mark(edges)
    tasks = max(1, -(-mark[0] // TASK_LINKS))
    edges = saved(edges.coalesce(tasks).mapInArrow(_stars, edges.schema))
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(lower.select("a", F.col("m").alias("b")))
        edges = saved(small.coalesce(tasks).distinct().coalesce(tasks))
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
