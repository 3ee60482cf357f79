"""Runs of hits in a row, by key, from summaries that merge: no task needs all rows of a key.

Rows of a key are cut into buckets of their order's first column. Inside a bucket a window numbers the runs; a bucket's
summary is (length, prefix, suffix, longest), the hits it begins with, ends with and has in a row at most. Two summaries of
neighbours merge into one, so buckets are merged by a tree, FAN at a time, and what a bucket's first run continues comes
down the same tree.

A null hit is none, null keys are a key, null places come first, and rows must have a total order within their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.joins import same
from folioscope.sources.scratch import kept

#: Children of a node of the tree.
FAN = 64
#: Seconds (or units of a number) of a bucket.
WIDTH = 3600.0
_ZERO = "named_struct('length', 0L, 'prefix', 0L, 'suffix', 0L, 'longest', 0L)"


def merged(a: Column, b: Column) -> Column:
    """The summary of two neighbours; the empty one changes nothing."""
    return F.struct(
        (a["length"] + b["length"]).alias("length"),
        F.when(a["prefix"] == a["length"], a["length"] + b["prefix"]).otherwise(a["prefix"]).alias("prefix"),
        F.when(b["suffix"] == b["length"], a["suffix"] + b["length"]).otherwise(b["suffix"]).alias("suffix"),
        F.greatest(a["longest"], b["longest"], a["suffix"] + b["prefix"]).alias("longest"),
    )


def bucketed(events: DataFrame, key: str, order: Sequence[str], hit: Column, width: float) -> DataFrame:
    """events with the bucket, the run inside it, and whether the run begins with the bucket."""
    at = F.col(order[0])
    at = at.cast("timestamp") if isinstance(events.schema[order[0]].dataType, T.DateType | T.TimestampNTZType) else at
    rows = events.withColumns({"_bucket": F.floor(at.cast("double") / width).cast("long"), "_hit": F.coalesce(hit, F.lit(False))})
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(w).cast("long"))
    miss = F.max(F.when(~F.col("_hit"), F.col("_n"))).over(w)
    return rows.withColumn("_miss", F.coalesce(miss, F.lit(0))).withColumns({"_run": F.col("_n") - F.col("_miss"), "_open": F.col("_miss") == 0})


def summaries(rows: DataFrame, key: str) -> DataFrame:
    own = F.struct(F.count("*").alias("length"), F.coalesce(F.max(F.when(F.col("_open"), F.col("_run"))), F.lit(0)).alias("prefix"), F.max_by("_run", "_n").alias("suffix"), F.max("_run").alias("longest"))
    return rows.groupBy(key, F.col("_bucket").alias("node")).agg(own.alias("s"))


def levels(leaves: DataFrame, key: str) -> tuple[list[DataFrame], int]:
    """(key, node, children, s) of each level above the leaves, up to one node a key, children in order; the first bucket.

    Each level is written, as two later steps read it; the one above has a FAN-th of its rows. Buckets count from 1; rows
    without a place are leaf 0, into which nothing is carried.
    """
    leaves = kept(leaves)
    low, high = leaves.agg(F.coalesce(F.min("node"), F.lit(0)), F.coalesce(F.max("node"), F.lit(0))).first()
    most = high - low + 1
    found, below = [], leaves.withColumn("node", F.coalesce(F.col("node") - F.lit(low) + 1, F.lit(0)))
    while not found or most:
        parents = below.groupBy(key, F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "s"))).alias("children"))  # FAN at most
        below = kept(parents.withColumn("s", F.aggregate("children", F.expr(_ZERO), lambda a, c: merged(a, c["s"]))))
        found.append(below)
        most //= FAN
    return found, low


def longest(events: DataFrame, key: str, order: Sequence[str], hit: Column, width: float = WIDTH) -> DataFrame:
    """key and its longest run."""
    tree, _ = levels(summaries(bucketed(events, key, order, hit, width), key), key)
    return tree[-1].select(key, F.col("s.longest").alias("longest"))


def carries(tree: list[DataFrame], key: str) -> DataFrame:
    """(key, node, carry) of the leaves: the hits in a row just before each."""

    def below(parents: DataFrame) -> DataFrame:
        after = lambda carry, s: F.when(s["suffix"] == s["length"], carry + s["length"]).otherwise(s["suffix"])
        step = lambda a, c: F.struct(after(a["carry"], c["s"]).alias("carry"), F.concat(a["found"], F.array(F.struct(c["node"].alias("node"), a["carry"].alias("carry")))).alias("found"))
        first = F.struct(F.col("carry"), F.array().cast("array<struct<node:bigint,carry:bigint>>").alias("found"))
        return parents.select(key, F.explode(F.aggregate("children", first, step, lambda a: a["found"])).alias("x")).select(key, "x.node", "x.carry")

    found = below(tree[-1].withColumn("carry", F.lit(0).cast("long")))
    for parents in reversed(tree[:-1]):
        found = below(parents.alias("a").join(found.alias("b"), same("a", "b", [key, "node"])).select("a.*", "b.carry"))
    return found


def numbered(events: DataFrame, key: str, order: Sequence[str], hit: Column, width: float = WIDTH, name: str = "run") -> DataFrame:
    """events with the number of hits in a row up to each."""
    rows = bucketed(events, key, order, hit, width)
    tree, low = levels(summaries(rows, key), key)
    carry = carries(tree, key).where("carry > 0").select(key, (F.col("node") - 1 + F.lit(low)).alias("_bucket"), F.col("carry").alias("_carry"))
    found = rows.alias("a").join(carry.alias("b"), same("a", "b", [key, "_bucket"]), "left")
    run = F.col("a._run") + F.when(F.col("a._open"), F.coalesce("b._carry", F.lit(0))).otherwise(0)
    return found.select(*[F.col(f"a.{c}") for c in events.columns], run.alias(name))
