"""A table of one row a key in folders by a hash of the key, where a change rewrites only the folders it touches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.scratch import file_system, kept


@dataclass(frozen=True)
class Buckets:
    """schema: the rows' columns in DDL. n: folders, a fixed property of the table."""

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    n: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def _whole(self) -> DataFrame:
        fs, target = file_system(self.spark, self.path)
        if not fs.exists(target):
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._whole().drop("bucket")

    def add(self, batch: DataFrame, order: Sequence[str], replaceable: Column | None = None) -> int:
        """Rows of a batch with new keys, the first of each in order; a row the table has is replaced only where
        replaceable holds for it. Returns how many folders were rewritten: none if nothing is new."""
        names = self.spark.createDataFrame([], self.schema).columns
        rest = [c for c in names if c not in self.keys]
        first = batch.groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        picked = first.select(*[F.col(c) if c in self.keys else F.col(f"_r.{c}").alias(c) for c in names]).withColumn("bucket", self._bucket())
        whole = self._whole()
        final = whole if replaceable is None else whole.where(~F.coalesce(replaceable, F.lit(False)))
        changes = kept(picked.join(final.select(*self.keys), list(self.keys), "left_anti").select(*names, "bucket"))
        touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # n numbers at most
        if not touched:
            return 0
        stay = whole.where(F.col("bucket").isin(touched)).join(changes.select(*self.keys), list(self.keys), "left_anti")
        merged = kept(stay.select(*names, "bucket").unionByName(changes))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return len(touched)
