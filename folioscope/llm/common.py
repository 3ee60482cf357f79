"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words; a word is a maximal run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken, base: str) -> str:
    """A column name like base that clashes with none of the taken ones, whatever their case."""
    low = {x.lower() for x in taken}
    name, n = base, 0
    while name.lower() in low:
        n += 1
        name = f"{base}_{n}"
    return name


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed inner names, so extra columns cannot clash: only(df, doc_id="id")."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    The setting is the cluster's; only where there is none (a local session) does the driver set its own.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or (context.getCheckpointDir() or "")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        context.setCheckpointDir(base)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store that no table reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(uri: str):
    """(file system, path) of a URI in the shared store, for code that runs in Python workers."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(uri)
