"""The dating stage: evidence of all sources for each document, then an accepted year or a place in the review queue.

Documents (id, url, portal_id, anchor, created, modified, title, readable, html, method): created, modified and title come
from the file's metadata, which readable says could be read; html is the page that links to it; method is set where a year
was accepted before. One pass judges every document and is written once; decisions, queue rows, evidence and counters all
come from that table.

Documents with a method, or whose URL has any queue row, are left alone, so a second run changes nothing. Unreadable ones
are errors and come again with the next run. Of several documents of a URL those after the first that is queued are left
alone too. Null texts are no evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioscope.functions import years
from folioscope.functions.dictionaries import DATING_ORDER
from folioscope.operators.joins import row_numbers
from folioscope.operators.rules import dating
from folioscope.operators.stages import enqueue, update_by_key
from folioscope.sources.scratch import kept

ACCEPTED, QUEUED, FAILED, SKIPPED = "aceito", "fila", "erro", "pulado"


def _union(*found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*found)))


def evidence() -> tuple[Column, Column]:
    """(map of source to years in the window, all years out of it) of a document's columns."""
    anchor = F.coalesce("anchor", F.lit(""))
    dates = [F.coalesce(F.regexp_extract(F.trim(F.col(c)), r"^(?:D:)?(\d{4})", 1), F.lit("")) for c in ("created", "modified")]
    title = F.coalesce("title", F.lit(""))
    page = years.html_dates(F.col("html"))
    meta = _union(*[years.inside(d) for d in dates], years.inside(title))
    sources = F.create_map(F.lit("url"), years.inside_path(F.col("url")), F.lit("ancora"), years.inside(anchor), F.lit("pdf_meta"), meta, F.lit("time_tag"), page)
    return sources, _union(years.outside_path(F.col("url")), years.outside(anchor), *[years.outside(d) for d in dates], years.outside(title))


def judged(documents: DataFrame, queue: DataFrame, skip_agreed: bool = False) -> DataFrame:
    """id, url, portal_id, outcome, year, method, reason, sources and outside, a row for each document.

    skip_agreed: the page is not consulted where two other sources agree on one year and none has another.
    """
    queued = queue.select("url").distinct().withColumn("_queued", F.lit(True))
    sources, outside = evidence()
    rows = documents.join(queued, "url", "left").withColumns({"sources": sources, "outside": outside})
    if skip_agreed:
        others = F.map_filter("sources", lambda k, v: (k != "time_tag") & (F.size(v) > 0))
        agreed = (F.size(F.array_distinct(F.flatten(F.map_values(others)))) == 1) & (F.size(F.map_keys(others)) > 1)
        rows = rows.withColumn("sources", F.when(agreed, others).otherwise(F.col("sources")))
    rows = rows.withColumn("_d", dating(F.col("sources"), DATING_ORDER))
    outcome = F.when(F.col("method").isNotNull() | F.col("_queued").isNotNull(), SKIPPED).when(~F.coalesce("readable", F.lit(False)), FAILED).when(F.col("_d.reason").isNull(), ACCEPTED).otherwise(QUEUED)
    rows = kept(rows.select("id", "url", "portal_id", outcome.alias("outcome"), F.col("_d.year").alias("year"), F.col("_d.method").alias("method"), F.col("_d.reason").alias("reason"), "sources", "outside"))
    first = rows.where(F.col("outcome") == QUEUED).groupBy("url").agg(F.min("id").alias("_first"))
    late = F.coalesce(F.col("id") > F.col("_first"), F.lit(False))
    final = rows.join(first, "url", "left").withColumn("outcome", F.when(late, SKIPPED).otherwise(F.col("outcome"))).drop("_first")
    clear = lambda c, kept_for: F.when(F.col("outcome").isin(*kept_for), F.col(c)).alias(c)
    return final.select("id", "url", "portal_id", "outcome", clear("year", [ACCEPTED]), clear("method", [ACCEPTED]), clear("reason", [QUEUED]), "sources", "outside")


@dataclass(frozen=True)
class Dated:
    """documents and queue after the stage, evidence (id, url, source, years) and how many documents had each outcome."""

    outcomes: DataFrame
    documents: DataFrame
    queue: DataFrame
    evidence: DataFrame
    counters: dict[str, int]


def date_documents(documents: DataFrame, queue: DataFrame, skip_agreed: bool = False) -> Dated:
    """One run over documents and queue (id, url, portal_id, status, ...)."""
    seen = Observation()
    counted = [F.count_if(F.col("outcome") == o).alias(o) for o in (ACCEPTED, QUEUED, FAILED, SKIPPED)]
    outcomes = kept(judged(documents, queue, skip_agreed).observe(seen, *counted))
    accepted = outcomes.where(F.col("outcome") == ACCEPTED).select("id", "method", F.col("year").alias("accepted_year"))
    base = documents if "accepted_year" in documents.columns else documents.withColumn("accepted_year", F.lit(None).cast("int"))
    last = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = row_numbers(outcomes.where(F.col("outcome") == QUEUED).select("id", "url", "portal_id", "reason"), ["id"], "_n")
    new = new.join(F.broadcast(last)).select((F.col("_last") + F.col("_n")).alias("id"), "url", "portal_id", "reason")  # last is one row
    consulted = outcomes.where(F.col("outcome").isin(ACCEPTED, QUEUED)).select("id", "url", F.explode("sources").alias("source", "years")).where((F.col("source") == "url") | (F.size("years") > 0))
    return Dated(outcomes, update_by_key(base, accepted, ["id"]).drop("updated"), enqueue(queue, new), consulted, dict(seen.get))
