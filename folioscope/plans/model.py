"""The catalogue's tables made from the driver's star schema, in Spark and (for the oracle) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.catalog import Catalog

CATEGORIES = ("integra", "agencia_inovacao", "incubadora", "extensao", "pesquisa", "reitoria", "outros")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    t = lambda name: table(spark, sf_dir, name)
    orders, events = t("orders"), t("events")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    year = F.year("o_orderdate")
    documents = orders.select(
        key.alias("id"),
        cust.alias("call_id"),
        (cust % 150 * 1000 + key % 20).alias("url"),
        F.col("o_orderdate").alias("captured_at"),
        F.when(key % 3 == 0, (year + 24).cast("int")).alias("accepted_year"),
        F.when(key % 5 < 3, (year + 24).cast("int")).alias("provisional_year"),
        F.when(key % 4 != 0, F.concat(F.lit("t/"), key.cast("string"))).alias("text_path"),
        (key % 7 * 50).alias("text_chars"),
        (key % 6 == 0).alias("scanned"),
        F.when(key % 12 == 0, F.col("o_orderdate")).alias("ocr_at"),
        F.substring(F.sha2((key % 5000).cast("string"), 256), 1, 12).alias("hash"),
        key.alias("seq"),
    )
    url = F.col("user_id") * 1000 + F.col("event_id") % 20
    bought = F.col("event_type") == "purchase"
    queue = events.select(
        F.col("event_id").alias("id"),
        url.alias("url"),
        (F.col("event_id") % 10 + 1).alias("portal_id"),
        F.when(bought, "resolvida").otherwise("pendente").alias("status"),
        F.when(bought & (F.col("event_id") % 4 != 0), (2019 + F.col("event_id") % 8).cast("int")).alias("decided_year"),
        (bought & (F.col("event_id") % 4 == 0)).alias("excluded"),
    )
    candidates = events.select(
        F.col("event_id").alias("id"),
        url.alias("url"),
        (F.col("event_id") % 10 + 1).alias("portal_id"),
        F.when(F.col("event_id") % 3 == 0, "pagina_edital").otherwise("pdf").alias("kind"),
        F.concat(F.lit("Edital "), F.col("event_type")).alias("anchor"),
    )
    labels = t("labels")
    classified = labels.groupBy((F.col("doc_id") % 150 * 1000 + F.col("doc_id") % 20).alias("url")).agg(F.max("quality").alias("q"), F.max("toxic").alias("x"), F.min("doc_id").alias("d"))
    classifications = classified.select(
        "url",
        F.when(F.col("q") == 1, "inovacao").otherwise("nao_inovacao").alias("kind"),
        F.when(F.col("d") % 4 == 0, None).when(F.col("x") == 1, "IMPACTO_SUBSTANTIVO").when(F.col("d") % 4 == 1, "IMPACTO_INSTRUMENTAL").otherwise("AUSENTE_SILENCIAMENTO").alias("axis3"),
    )
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return Catalog(
        institutions=t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("code")),
        portals=t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("institution_id"), category.alias("category")),
        calls=t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("institution_id")),
        documents=documents,
        candidates=candidates,
        queue=queue,
        classifications=classifications,
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a text corpus: source is the institution, doc_id gives a year."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("source").alias("institution"), (2019 + F.col("doc_id") % 8).cast("int").alias("year"))


#: The same tables, and the base rows (J1-J4), for DuckDB.
SQL = """
WITH institutions AS (SELECT n_nationkey AS id, n_name AS code FROM nation),
portals AS (SELECT s_suppkey AS id, s_nationkey AS institution_id, ['integra', 'agencia_inovacao', 'incubadora', 'extensao', 'pesquisa', 'reitoria', 'outros'][1 + s_suppkey % 7] AS category FROM supplier),
calls AS (SELECT c_custkey AS id, c_nationkey AS institution_id FROM customer),
docs AS (SELECT o_orderkey AS id, o_custkey AS call_id, o_custkey % 150 * 1000 + o_orderkey % 20 AS url, o_orderdate AS captured_at,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) + 24 AS INT) END AS accepted_year, CASE WHEN o_orderkey % 5 < 3 THEN CAST(year(o_orderdate) + 24 AS INT) END AS provisional_year,
  CASE WHEN o_orderkey % 4 <> 0 THEN 't/' || o_orderkey END AS text_path, o_orderkey % 7 * 50 AS text_chars, o_orderkey % 6 = 0 AS scanned,
  CASE WHEN o_orderkey % 12 = 0 THEN o_orderdate END AS ocr_at, substr(sha256(CAST(o_orderkey % 5000 AS VARCHAR)), 1, 12) AS hash, o_orderkey AS seq FROM orders),
queue AS (SELECT event_id AS id, user_id * 1000 + event_id % 20 AS url, event_id % 10 + 1 AS portal_id, CASE WHEN event_type = 'purchase' THEN 'resolvida' ELSE 'pendente' END AS status,
  CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN CAST(2019 + event_id % 8 AS INT) END AS decided_year, event_type = 'purchase' AND event_id % 4 = 0 AS excluded FROM events),
candidates AS (SELECT event_id AS id, user_id * 1000 + event_id % 20 AS url, event_id % 10 + 1 AS portal_id, CASE WHEN event_id % 3 = 0 THEN 'pagina_edital' ELSE 'pdf' END AS kind, 'Edital ' || event_type AS anchor FROM events),
classified AS (SELECT doc_id % 150 * 1000 + doc_id % 20 AS url, max(quality) AS q, max(toxic) AS x, min(doc_id) AS d FROM labels GROUP BY 1),
classifications AS (SELECT url, CASE WHEN q = 1 THEN 'inovacao' ELSE 'nao_inovacao' END AS kind, CASE WHEN d % 4 = 0 THEN NULL WHEN x = 1 THEN 'IMPACTO_SUBSTANTIVO' WHEN d % 4 = 1 THEN 'IMPACTO_INSTRUMENTAL' ELSE 'AUSENTE_SILENCIAMENTO' END AS axis3 FROM classified),
effective AS (SELECT url, coalesce(max(CASE WHEN status = 'resolvida' THEN id END), max(id)) AS queue_id FROM queue GROUP BY url),
decisions AS (SELECT e.url, q.id AS queue_id, q.status AS queue_status, q.decided_year, coalesce(q.excluded, false) AS excluded FROM effective e JOIN queue q ON q.id = e.queue_id),
base AS (SELECT d.*, i.code AS institution, p.category, c.portal_id, coalesce(f.excluded, false) AS excluded, CAST(coalesce(d.accepted_year, f.decided_year) AS INT) AS year,
  CASE WHEN d.accepted_year IS NOT NULL THEN 'automatica' WHEN f.decided_year IS NOT NULL THEN 'fila_humana' ELSE 'vazio' END AS year_source
  FROM docs d JOIN calls e ON e.id = d.call_id JOIN institutions i ON i.id = e.institution_id
  LEFT JOIN (SELECT url, min(portal_id) AS portal_id FROM candidates WHERE kind = 'pdf' GROUP BY url) c ON c.url = d.url
  LEFT JOIN portals p ON p.id = c.portal_id LEFT JOIN decisions f ON f.url = d.url),
coverage AS (SELECT institution, coalesce(year, provisional_year, 0) AS ano, count(*) AS n_docs, count(*) FILTER (text_path IS NOT NULL) AS textuados,
  count(*) FILTER (text_path IS NOT NULL AND text_chars > 0) AS com_texto_util, count(*) FILTER (scanned) AS escaneados, count(*) FILTER (ocr_at IS NOT NULL) AS resgatados_ocr,
  count(*) FILTER (year IS NOT NULL) AS datados, count(*) FILTER (k.kind IS NOT NULL) AS classificados_l1, count(*) FILTER (k.axis3 IS NOT NULL) AS eixo3, count(*) FILTER (excluded) AS excluidos
  FROM base LEFT JOIN classifications k ON k.url = base.url GROUP BY 1, 2),
corpus AS (SELECT doc_id, text, lang, source AS institution, CAST(2019 + doc_id % 8 AS INT) AS year FROM documents),
toks AS (SELECT doc_id, institution, year, list_filter(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '\\p{L}[\\p{L}\\p{N}_]+')), lambda x: x NOT IN ('the', 'and', 'of', 'that', 'with', 'this')) AS w FROM corpus)
"""
