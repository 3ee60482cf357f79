"""Connected components of an edge table: union-find in one task up to SMALL edges, beyond by alternating large and small stars.

Each round of stars replaces edges so that nodes point at ever smaller neighbours; a node's neighbours are never gathered, only
their minimum is (with partial sums), and joined back, which Spark can split where a node has very many. Every round is
written to the shared folder, so lineage stays short and a lost executor costs no more than its own tasks. Both ways
give the same result.

Defined results: an edge from a node to itself and one with a null end don't count; repeated edges count once; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written


#: Edges (16 bytes each, about 200 as a Python dictionary) that one task joins.
SMALL = 500_000


def _joined(batches):
    parent: dict = {}

    def root(x):
        top = x
        while (above := parent.get(top, top)) != top:
            top = above
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((root(u), root(v)))
            parent[b], parent[a] = a, a
    nodes = list(parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["node", "component"])


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minima(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _minima(down)
    moved = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge. edges: u, v of one orderable type."""
    now = written(edges.where("u <> v").select("u", "v").distinct())
    if now.count() <= SMALL:
        kind = now.schema["u"].dataType.simpleString()
        return written(now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    mark = None
    while True:
        now = written(_small(_large(now)))
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
