"""The two classification stages as runs over a bucketed table: what is definitive stays, the excluded are left out.

Documents (id, url, portal_id, text, anchor, excluded). A URL has one row in the table. A run takes the documents it is
aimed at, leaves out excluded ones and URLs with a definitive row, judges the rest and adds them; a second run finds
nothing to judge and rewrites no folder. Of several documents of a URL the first with a definitive result counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import dictionaries as D
from folioscope.operators import rules
from folioscope.sources.buckets import Buckets

LEVEL1 = "url string, kind string, method string, signals array<string>, dimensions array<string>, anchor_evidence string"
AXIS3 = "url string, code string, evidence string"
#: A result that a later run may replace.
NO_TEXT = "sem_texto"


def aimed(documents: DataFrame, portal: int | None = None, url: str | None = None, sweep: DataFrame | None = None, every: bool = False) -> DataFrame:
    """The documents of one portal, one URL, one sweep's URLs, or all: exactly one of the four."""
    if sum((portal is not None, url is not None, sweep is not None, every)) != 1:
        raise ValueError("exactly one of portal, url, sweep and every")
    if sweep is not None:
        return documents.join(sweep.select("url").distinct(), "url", "left_semi")
    return documents if every else documents.where(F.col("portal_id") == portal if portal is not None else F.col("url") == url)


def _pending(documents: DataFrame, done: DataFrame) -> DataFrame:
    return documents.where(~F.coalesce("excluded", F.lit(False))).join(done.select("url"), "url", "left_anti")


def level1(documents: DataFrame, table: Buckets, signals: Sequence[str], dimensions: dict[str, Sequence[str]]) -> int:
    """Rewritten folders."""
    pending = _pending(documents, table.read().where(F.col("method") != NO_TEXT))
    found = rules.classify(pending.select("id", "url", "text", "anchor"), signals, dimensions).withColumn("_weak", F.col("method") == NO_TEXT)
    # a URL without text that has none still isn't new
    known = table.read().where(F.col("method") == NO_TEXT).select("url").withColumn("_known", F.lit(True))
    fresh = found.join(known, "url", "left").where(~(F.col("_weak") & F.col("_known").isNotNull()))
    return table.add(fresh, ["_weak", "id"], F.col("method") == NO_TEXT)


def axis3(documents: DataFrame, table: Buckets, **dictionaries) -> int:
    """Rewritten folders. Documents without text are left for a later run; silence may be replaced, by another code."""
    pending = _pending(documents, table.read().where(F.col("code") != D.SILENCE)).where(F.col("text").isNotNull())
    found = pending.select("id", "url", rules.axis3(F.col("text"), **dictionaries).alias("r")).select("id", "url", "r.code", "r.evidence").withColumn("_weak", F.col("code") == D.SILENCE)
    known = table.read().where(F.col("code") == D.SILENCE).select("url").withColumn("_known", F.lit(True))
    fresh = found.join(known, "url", "left").where(~(F.col("_weak") & F.col("_known").isNotNull()))
    return table.add(fresh, ["_weak", "id"], F.col("code") == D.SILENCE)


def totals(documents: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Documents of each portal by result; 'excluido' where they were left out, 'pendente' without a result."""
    rows = documents.join(table.select("url", column), "url", "left")
    result = F.when(F.coalesce("excluded", F.lit(False)), "excluido").otherwise(F.coalesce(column, F.lit("pendente")))
    return rows.groupBy("portal_id", result.alias("result")).agg(F.count("*").alias("n"))
