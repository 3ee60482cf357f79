"""Joins and lookups that stay even when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import kept

#: A key is frequent if it holds more than one in so many of the rows, so there are fewer frequent keys than this.
FREQUENT = 1000


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    cond = F.col(f"{a}.{keys[0]}").eqNullSafe(F.col(f"{b}.{keys[0]}"))
    for k in keys[1:]:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def attached(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, share: int = FREQUENT) -> DataFrame:
    """rows with the columns of a table that has one row a key and, in a column, how many rows hold the key.

    Frequent keys are fewer than share, so they are sent to all tasks and their rows stay where they are; the others are
    shuffled. rows are read twice: give a written table.
    """
    extra = [c for c in table.columns if c not in keys and c != count]
    total = table.agg(F.sum(count).alias("_total"))
    marked = table.join(F.broadcast(total)).withColumn("_frequent", F.col(count) * share > F.col("_total")).drop("_total", count)  # total is one row
    frequent = marked.where("_frequent").drop("_frequent")
    a = rows.alias("a")
    hot = a.join(F.broadcast(frequent.alias("b")), same("a", "b", keys))  # fewer rows than share
    rest = a.join(F.broadcast(frequent.alias("b")), same("a", "b", keys), "left_anti").alias("a").join(marked.where("NOT _frequent").alias("b"), same("a", "b", keys), "left")
    both = [F.col(f"a.{c}") for c in rows.columns] + [F.col(f"b.{c}") for c in extra]
    return hot.select(*both).unionByName(rest.select(*both))


def with_predecessor(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """rows with struct<value> of the row before of the same key, null for the first.

    The rows are dealt out by ranges of (key, order), so one key may fill many ranges. Inside a range the row before is a
    lag; the first row of a range takes the last row of the range before, of which there is one a range.
    """
    placed = kept(rows.repartitionByRange(F.col(key), F.col(order)).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", key).orderBy(order)
    last = placed.groupBy("_range").agg(F.max_by(F.struct(F.col(key).alias("key"), F.col(value).alias("value")), F.struct(key, order)).alias("_l"))
    carried = last.select("_range", F.lag("_l").over(Window.orderBy("_range")).alias("_carried"))  # one row a range
    found = placed.withColumn("_before", F.lag(F.struct(F.col(value).alias("value"))).over(inside)).join(F.broadcast(carried), "_range", "left")
    before = F.coalesce("_before", F.when(F.col("_carried.key").eqNullSafe(F.col(key)) & F.col("_carried").isNotNull() & (F.row_number().over(inside) == 1), F.struct(F.col("_carried.value").alias("value"))))
    return found.withColumn(name, before).select(*rows.columns, name)


def row_numbers(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows numbered from 1 in a total order over all of them: by ranges, each of which adds the sizes of those before."""
    placed = kept(rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + inside).alias(name))
