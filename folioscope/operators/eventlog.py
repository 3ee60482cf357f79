"""The append-only event log: details as VARIANT, canonical JSON, a folder a day.

A detail is an object with any names and depths, so it is kept as a VARIANT: parsed once when it is written, read by path
and type without parsing again. What isn't JSON becomes {}. Names of objects come out sorted at every depth, so equal
details are equal texts. Days are only ever added to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "ts timestamp, command string, kind string, detail variant"


def parsed(detail: Column) -> Column:
    """A JSON text as VARIANT; {} for null and for what isn't JSON."""
    return F.coalesce(F.try_parse_json(detail), F.parse_json(F.lit("{}")))


def canonical(detail: Column) -> Column:
    """The JSON text of a VARIANT with sorted names."""
    return F.to_json(detail)


def event(command: str, kind: str, detail: Column, ts: Column | None = None) -> list[Column]:
    """K1: an event row's columns; detail is a struct, map or JSON text's column given by to_json()."""
    return [(F.current_timestamp() if ts is None else ts).alias("ts"), F.lit(command).alias("command"), F.lit(kind).alias("kind"), parsed(detail).alias("detail")]


def append(rows: DataFrame, path: str) -> None:
    """Adds events (ts, command, kind, detail) to their days."""
    rows.select("ts", "command", "kind", "detail", F.to_date("ts").alias("day")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{COLUMNS}, day date").parquet(path)


def latest(spark: SparkSession, path: str, n: int) -> DataFrame:
    """O3: the newest events, all columns but the day."""
    return read(spark, path).drop("day").orderBy(F.desc("ts"), "command", "kind").limit(n)


def entries(rows: DataFrame, key: str, log: str) -> DataFrame:
    """P10: the entries of a VARIANT's object (name, value) or list (position from 1, value); others have none. Texts come
    without quotes, all else as JSON."""
    spark = rows.sparkSession
    each = rows.select(key, F.col(log).alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    name = F.coalesce(F.col("key"), (F.col("pos") + 1).cast("string"))
    return each.select(key, name.alias("etapa"), F.when(~F.is_variant_null("value"), F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))).alias("valor"))


def log_entries(rows: DataFrame, key: str, log: str) -> DataFrame:
    """P10 of a JSON text; bad JSON has no entries."""
    return entries(rows.select(key, parsed(F.col(log)).alias("_log")), key, "_log")
