"""Stages over arriving rows: each run takes what is new and applies an idempotent upsert, exactly once by checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(rows: DataFrame, stage: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every batch of new rows to stage(rows, batch id), then stops."""
    q = rows.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def versioned_upsert(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A stage that keeps new keys only and writes them as one folder a batch: a repeated batch overwrites its own."""

    def stage(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        # the smallest row of a key, so that a repeated batch picks the same one
        first = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*[F.col(c) if c in keys else F.col("_r").getField(c).alias(c) for c in batch.columns]) if rest else batch.distinct()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hadoop):
            old = spark.read.option("basePath", path).parquet(path)
            if "batch" in old.columns:
                old = old.where(F.col("batch") != batch_id)
            first = first.join(old.select(*keys), list(keys), "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stage


def suspensions(events: DataFrame, limit: int = 3) -> DataFrame:
    """A19 for a stream (host, ts, status): hosts that have just reached limit refusals in a row."""
    import pandas as pd

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(frames)).sort_values("ts").itertuples():
            run = run + 1 if row.status == 403 else 0
            if run == limit:
                out.append((key[0], row.ts, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["host", "ts", "run"])

    return events.groupBy("host").applyInPandasWithState(step, "host string, ts timestamp, run long", "run long", "append", "NoTimeout")
