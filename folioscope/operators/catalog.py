"""The catalogue of collected documents: which decision applies, where a year came from, how far each group has got.

All functions are lazy and relational. Small dimensions (institutions, portals, calls) are joined without hints: the
engine broadcasts what it finds small at run time and shuffles the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLVED, PENDING = "resolvida", "pendente"
STAGES = ("textuados", "com_texto_util", "escaneados", "resgatados_ocr", "datados", "classificados_l1", "eixo3", "excluidos")


@dataclass(frozen=True)
class Catalog:
    """institutions(id, code), portals(id, institution_id, category), calls(id, institution_id), documents(id, call_id,
    url, captured_at, accepted_year, provisional_year, text_path, text_chars, scanned, ocr_at, hash, seq),
    candidates(id, url, portal_id, kind, anchor), queue(id, url, portal_id, status, decided_year, excluded),
    classifications(url, kind, axis3)."""

    institutions: DataFrame
    portals: DataFrame
    calls: DataFrame
    documents: DataFrame
    candidates: DataFrame
    queue: DataFrame
    classifications: DataFrame


def effective_queue(queue: DataFrame) -> DataFrame:
    """A1: of each URL the newest resolved row, else the newest row. One aggregation, no self-join."""
    resolved = F.when(F.col("status") == RESOLVED, F.col("id"))
    return queue.groupBy("url").agg(F.coalesce(F.max(resolved), F.max("id")).alias("queue_id"))


def effective_decisions(queue: DataFrame) -> DataFrame:
    """The effective row itself, picked in the same aggregation: resolved before pending, then the largest id."""
    best = F.max_by(F.struct("id", "status", "decided_year", "excluded"), F.struct((F.col("status") == RESOLVED).cast("int"), F.col("id")))
    return queue.groupBy("url").agg(best.alias("q")).select("url", F.col("q.id").alias("queue_id"), F.col("q.status").alias("queue_status"), F.col("q.decided_year").alias("decided_year"), F.coalesce("q.excluded", F.lit(False)).alias("excluded"))


def portal_of_url(candidates: DataFrame) -> DataFrame:
    """One portal a URL, so a URL that two portals list doesn't multiply documents."""
    return candidates.where(F.col("kind") == "pdf").groupBy("url").agg(F.min("portal_id").alias("portal_id"), F.max(F.when(F.trim("anchor") != "", F.col("anchor"))).alias("anchor"))


def year_source() -> Column:
    """P3."""
    return F.when(F.col("accepted_year").isNotNull(), "automatica").when(F.col("decided_year").isNotNull(), "fila_humana").otherwise("vazio")


def base(c: Catalog) -> DataFrame:
    """Documents with institution, portal, effective decision and classification."""
    inst = c.institutions.select(F.col("id").alias("institution_id"), F.col("code").alias("institution"))
    calls = c.calls.select(F.col("id").alias("call_id"), "institution_id")
    portals = c.portals.select(F.col("id").alias("portal_id"), "category")
    rows = c.documents.join(calls, "call_id").join(inst, "institution_id").join(portal_of_url(c.candidates), "url", "left").join(portals, "portal_id", "left").join(effective_decisions(c.queue), "url", "left")
    rows = rows.withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    return rows.withColumns({"year": F.coalesce("accepted_year", "decided_year").cast("int"), "year_source": year_source()})


def filters(institution: str | None = None, year: int | None = None, category: str | None = None, call: str | None = None, *, excluded: bool = False, ignore_year: bool = False) -> Column:
    """The conjunction of the given filters; LIKE wildcards in call are not escaped, by design."""
    clause = F.col("excluded") if excluded else ~F.col("excluded")
    if institution is not None:
        clause &= F.upper("institution") == institution.upper()
    if year is not None and not ignore_year:
        clause &= F.col("year") == year
    if category is not None:
        clause &= F.col("category") == category
    if call is not None:
        clause &= F.upper(F.col("call_id").cast("string")).like(f"%{call.upper()}%")
    return clause


LISTED = ("id", "call_id", "institution", "category", "year", "year_source", "url", "captured_at", "hash")


def listing(c: Catalog, institution: str | None = None, year: int | None = None, category: str | None = None, call: str | None = None, limit: int | None = None) -> DataFrame:
    """The listed documents, undated ones last (O1), at most limit of them (O2)."""
    rows = base(c).where(filters(institution, year, category, call)).select(*LISTED)
    rows = rows.orderBy(F.col("year").isNull(), "institution", "year", "call_id", "id", "url")
    return rows if limit is None else rows.limit(limit)


def excluded_count(c: Catalog, institution: str | None = None, year: int | None = None, category: str | None = None, call: str | None = None) -> DataFrame:
    """excluded documents; the year filter does not apply to them."""
    return base(c).where(filters(institution, year, category, call, excluded=True, ignore_year=True)).agg(F.count("*").alias("n_excluded"))


def year_sources(listed: DataFrame) -> DataFrame:
    """A10: counts by year source over the listed rows."""
    return listed.groupBy("year_source").agg(F.count("*").alias("n"))


def coverage(c: Catalog) -> DataFrame:
    """Counts by institution and year over all documents, with the provisional year and 0 as fallbacks."""
    rows = base(c).join(c.classifications.select("url", F.col("kind").alias("class_kind"), "axis3"), "url", "left")
    has_text = F.col("text_path").isNotNull()
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return rows.groupBy("institution", F.coalesce("year", F.col("provisional_year").cast("int"), F.lit(0)).alias("ano")).agg(
        F.count("*").alias("n_docs"),
        n(has_text).alias("textuados"),
        n(has_text & (F.col("text_chars") > 0)).alias("com_texto_util"),
        n(F.col("scanned")).alias("escaneados"),
        n(F.col("ocr_at").isNotNull()).alias("resgatados_ocr"),
        n(F.col("year").isNotNull()).alias("datados"),
        n(F.col("class_kind").isNotNull()).alias("classificados_l1"),
        n(F.col("axis3").isNotNull()).alias("eixo3"),
        n(F.col("excluded")).alias("excluidos"),
    )


def funnel(cov: DataFrame) -> DataFrame:
    """Total of each stage and its share of all documents."""
    totals = cov.agg(F.sum("n_docs").alias("n_docs"), *[F.sum(s).alias(s) for s in STAGES])
    return totals.unpivot([F.greatest("n_docs", F.lit(1)).alias("total")], ["n_docs", *STAGES], "stage", "n").select("stage", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))


def by_institution(cov: DataFrame) -> DataFrame:
    """Sums by institution and three ratios."""
    sums = cov.groupBy("institution").agg(*[F.sum(x).alias(x) for x in ("n_docs", "textuados", "datados", "classificados_l1")])
    pct = lambda x: F.round(100 * F.col(x) / F.col("n_docs"), 1)
    return sums.withColumns({"pct_textuados": pct("textuados"), "pct_datados": pct("datados"), "pct_classificados": pct("classificados_l1")})


def ratios_long(institutions: DataFrame) -> DataFrame:
    """R6."""
    return institutions.unpivot("institution", ["pct_textuados", "pct_datados", "pct_classificados"], "etapa", "pct")


def pivot_counts(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """A count matrix with zeros; the columns are given, so no job looks for them."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0)


def dated_documents(c: Catalog) -> DataFrame:
    """A4: documents with an accepted year or a resolved year in the queue, each once."""
    automatic = c.documents.where(F.col("accepted_year").isNotNull()).select("url")
    human = c.queue.where((F.col("status") == RESOLVED) & F.col("decided_year").isNotNull()).select("url")
    return automatic.union(human).distinct().agg(F.count("*").alias("n"))


def text_stage() -> Column:
    """P5."""
    return F.when(F.col("text_path").isNull(), "pendentes").when(F.coalesce("scanned", F.lit(False)), "escaneados").otherwise("extraidos")


def text_stages(c: Catalog) -> DataFrame:
    """A5: counts by bucket, with zeros."""
    buckets = c.documents.sparkSession.createDataFrame([(x,) for x in ("extraidos", "escaneados", "pendentes")], "stage string")
    counted = c.documents.groupBy(text_stage().alias("stage")).agg(F.count("*").alias("n"))
    return buckets.join(counted, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def latest(events: DataFrame, n: int, key: str = "event_id") -> DataFrame:
    """O3."""
    return events.orderBy(F.desc(key)).limit(n)


def multi_version_share(c: Catalog) -> DataFrame:
    """Calls, those with several documents, and their share."""
    sizes = c.documents.groupBy("call_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("n_calls"), F.count_if(F.col("n") > 1).alias("n_multi")).withColumn("pct", F.round(100 * F.col("n_multi") / F.greatest("n_calls", F.lit(1)), 1))


def headline(rows: DataFrame) -> DataFrame:
    """The figures at the top of the dashboard, over the listed rows."""
    positive = F.when(F.col("year") > 0, F.col("year"))
    return rows.agg(F.count("*").alias("n_docs"), F.countDistinct("institution").alias("n_institutions"), F.countDistinct("call_id").alias("n_calls"), F.min(positive).alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("year_source") == "fila_humana").alias("n_human"))


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Share of each value of a column; the total is one row, summed from the counts."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select(column, "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))  # total is one row


def pipeline_status(c: Catalog) -> DataFrame:
    """A row for each candidate (and version of its document) with marks for the stages it has passed."""
    mark = lambda x: F.when(F.col(x).isNotNull(), "✔").otherwise("–")
    docs = c.documents.select("url", F.col("id").alias("doc_id"), "text_path", "accepted_year")
    cls = c.classifications.select("url", F.col("kind").alias("class_kind"), "axis3")
    axis = F.when(F.col("axis3").isNull(), "–").when(F.col("axis3") == "AUSENTE_SILENCIAMENTO", "silêncio").otherwise(F.col("axis3"))
    return c.candidates.join(docs, "url", "left").join(cls, "url", "left").select(F.col("id").alias("candidate_id"), "url", F.col("kind"), mark("doc_id").alias("baixado"), mark("text_path").alias("textuado"), mark("accepted_year").alias("datado"), mark("class_kind").alias("classificado"), axis.alias("eixo3"))


def axis3_status(c: Catalog, institution: str | None = None, per_version: bool = False) -> DataFrame:
    """Documents by axis-3 code. URLs count once; per_version counts every version, as a plain join would."""
    docs = c.documents
    if institution is not None:
        inst = c.institutions.where(F.upper("code") == institution.upper()).select(F.col("id").alias("institution_id"))
        docs = docs.join(c.calls.join(inst, "institution_id", "left_semi").select(F.col("id").alias("call_id")), "call_id", "left_semi")  # F11
    urls = docs.select("url") if per_version else docs.select("url").distinct()
    return c.classifications.where(F.col("axis3").isNotNull()).join(urls, "url").groupBy("axis3").agg(F.count("*").alias("n"))


def axis3_shares(c: Catalog, by: str, codes: tuple[str, ...]) -> DataFrame:
    """Percentage of each code by institution or year, with zeros for absent codes."""
    rows = base(c).join(c.classifications.select("url", "axis3"), "url").where(F.col("axis3").isNotNull())
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(F.col("axis3") == x).alias(f"n_{i}") for i, x in enumerate(codes)])
    return counts.select(by, *[F.round(100 * F.col(f"n_{i}") / F.col("n"), 1).alias(x) for i, x in enumerate(codes)])


def first_same_hash(documents: DataFrame) -> DataFrame:
    """For each document the first one of its portal with the same bytes and another URL.

    The two earliest URLs of a group answer for all its members, so a group is aggregated, never joined with itself.
    """
    firsts = documents.groupBy("portal_id", "hash", "url").agg(F.min("seq").alias("seq"))
    first = firsts.groupBy("portal_id", "hash").agg(F.min(F.struct("seq", "url")).alias("one"))
    second = firsts.join(first, ["portal_id", "hash"]).where(F.col("url") != F.col("one.url")).groupBy("portal_id", "hash").agg(F.first("one").alias("one"), F.min(F.struct("seq", "url")).alias("two"))
    own = documents.join(second, ["portal_id", "hash"])
    return own.select("id", "url", F.when(F.col("url") != F.col("one.url"), F.col("one.url")).otherwise(F.col("two.url")).alias("alias_of"))


def latest_version(documents: DataFrame) -> DataFrame:
    """The newest capture of each URL."""
    return documents.groupBy("url").agg(F.max_by(F.struct("id", "captured_at"), F.struct("captured_at", "seq")).alias("d")).select("url", F.col("d.id").alias("id"), F.col("d.captured_at").alias("captured_at"))


def to_classify(c: Catalog) -> DataFrame:
    """Documents with their anchor, portal and whether the effective decision excludes them."""
    return c.documents.join(portal_of_url(c.candidates), "url").join(effective_decisions(c.queue).select("url", "excluded"), "url", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def review_queue(c: Catalog, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Queue rows with portal and institution, oldest first."""
    portals = c.portals.select(F.col("id").alias("portal_id"), "institution_id", "category")
    inst = c.institutions.select(F.col("id").alias("institution_id"), F.col("code").alias("institution"))
    rows = c.queue.join(portals, "portal_id").join(inst, "institution_id").select("id", "url", "status", "category", "institution")
    rows = (rows if status is None else rows.where(F.col("status") == status)).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def custody(c: Catalog, call_ids: DataFrame | None = None) -> DataFrame:
    """For each call its documents in capture order, each with the queue rows that apply, as nested arrays."""
    docs = c.documents if call_ids is None else c.documents.join(call_ids, "call_id", "left_semi")
    decisions = effective_decisions(c.queue).select("url", F.struct("queue_id", "queue_status", "decided_year", "excluded").alias("queue"))
    rows = docs.join(decisions, "url", "left")
    each = F.struct("captured_at", "seq", "id", "url", "hash", "accepted_year", "queue")
    return rows.groupBy("call_id").agg(F.sort_array(F.collect_list(each)).alias("documents")).withColumn("custody_json", F.to_json(F.struct("call_id", "documents")))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
