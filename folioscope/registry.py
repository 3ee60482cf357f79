"""All queries of the library by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls, years
from folioscope.operators import catalog as C
from folioscope.operators import citations, coding, eventlog, mining, neighbours, reports, rules, stages
from folioscope.plans import model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STOP = ("the", "and", "of", "that", "with", "this")
DIMENSIONS = {"artigos": ("the", "that"), "preposicoes": ("of the", "with", "from"), "verbos": ("is", "was", "are")}
SIGNALS = ("worthless", "pathetic", "the idiot", "license")
CODES = ("IMPACTO_SUBSTANTIVO", "IMPACTO_INSTRUMENTAL", "AUSENTE_SILENCIAMENTO")
YEARS = list(range(2019, 2027))


def query(name: str, sql: str | None = None, base: bool = True):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (model.SQL if base else "") + sql
        return f

    return add


def on_catalog(name: str, f: Callable[[C.Catalog], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, d: f(model.catalog(spark, d)))


def on_corpus(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, d: f(model.corpus(spark, d)))


def on_table(name: str, table: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql, base=False)(lambda spark, d: f(model.table(spark, d, table)))


# ---- catalogue -------------------------------------------------------------------------------------------------

LISTED = "id, call_id, institution, category, year, year_source, url, captured_at, hash"
on_catalog("catalog_listing", lambda c: C.listing(c), f"SELECT {LISTED} FROM base WHERE NOT excluded")
on_catalog("catalog_listing_filtered", lambda c: C.listing(c, "nation_3", 2021, None, "1"), f"SELECT {LISTED} FROM base WHERE NOT excluded AND upper(institution) = 'NATION_3' AND year = 2021 AND CAST(call_id AS VARCHAR) LIKE '%1%'")
on_catalog("catalog_listing_limited", lambda c: C.listing(c, category="integra", limit=50), f"SELECT {LISTED} FROM base WHERE NOT excluded AND category = 'integra' ORDER BY year IS NULL, institution, year, call_id, id, url LIMIT 50")
on_catalog("effective_queue_row", lambda c: C.effective_queue(c.queue), "SELECT * FROM effective")
on_catalog("excluded_count", lambda c: C.excluded_count(c, year=2019), "SELECT count(*) AS n_excluded FROM base WHERE excluded")
on_catalog("year_source_summary", lambda c: C.year_sources(C.listing(c)), "SELECT year_source, count(*) AS n FROM base WHERE NOT excluded GROUP BY 1")
on_catalog("coverage_matrix", C.coverage, "SELECT * FROM coverage")
on_catalog("coverage_funnel", lambda c: C.funnel(C.coverage(c)), f""", t AS (SELECT unnest([{', '.join(f"{{'stage': '{s}', 'n': sum({s})}}" for s in ('n_docs', *C.STAGES))}]) AS x, greatest(sum(n_docs), 1) AS total FROM coverage)
SELECT x.stage AS stage, CAST(x.n AS BIGINT) AS n, round(CAST(100 * x.n AS DOUBLE) / CAST(total AS DOUBLE), 1) AS pct FROM t""")
BY_INSTITUTION = """SELECT institution, CAST(sum(n_docs) AS BIGINT) AS n_docs, CAST(sum(textuados) AS BIGINT) AS textuados, CAST(sum(datados) AS BIGINT) AS datados, CAST(sum(classificados_l1) AS BIGINT) AS classificados_l1,
round(CAST(100 * sum(textuados) AS DOUBLE) / CAST(sum(n_docs) AS DOUBLE), 1) AS pct_textuados, round(CAST(100 * sum(datados) AS DOUBLE) / CAST(sum(n_docs) AS DOUBLE), 1) AS pct_datados, round(CAST(100 * sum(classificados_l1) AS DOUBLE) / CAST(sum(n_docs) AS DOUBLE), 1) AS pct_classificados FROM coverage GROUP BY 1"""
on_catalog("coverage_by_institution", lambda c: C.by_institution(C.coverage(c)), BY_INSTITUTION)
on_catalog("coverage_long", lambda c: C.ratios_long(C.by_institution(C.coverage(c))), f", b AS ({BY_INSTITUTION}) SELECT institution, 'pct_textuados' AS etapa, pct_textuados AS pct FROM b UNION ALL SELECT institution, 'pct_datados', pct_datados FROM b UNION ALL SELECT institution, 'pct_classificados', pct_classificados FROM b")
on_catalog("inst_year_pivot", lambda c: C.pivot_counts(C.base(c), "institution", "year", YEARS), "SELECT institution, " + ", ".join(f'count(*) FILTER (year = {y}) AS "{y}"' for y in YEARS) + " FROM base GROUP BY 1")
on_catalog("year_histogram", lambda c: C.base(c).groupBy("year", "institution").agg(F.count("*").alias("n")), "SELECT year, institution, count(*) AS n FROM base GROUP BY 1, 2")
on_catalog("category_shares", lambda c: C.shares(C.base(c), "category"), "SELECT category, count(*) AS n, round(CAST(100 * count(*) AS DOUBLE) / CAST((SELECT count(*) FROM base) AS DOUBLE), 1) AS pct FROM base GROUP BY 1")
on_catalog("headline_figures", lambda c: C.headline(C.base(c)), "SELECT count(*) AS n_docs, count(DISTINCT institution) AS n_institutions, count(DISTINCT call_id) AS n_calls, min(year) FILTER (year > 0) AS first_year, max(year) AS last_year, count(*) FILTER (year_source = 'fila_humana') AS n_human FROM base")
on_catalog("dated_documents", C.dated_documents, "SELECT count(*) AS n FROM (SELECT url FROM docs WHERE accepted_year IS NOT NULL UNION SELECT url FROM queue WHERE status = 'resolvida' AND decided_year IS NOT NULL)")
on_catalog("text_stage_counts", C.text_stages, "SELECT s AS stage, count(b.id) AS n FROM (SELECT unnest(['extraidos', 'escaneados', 'pendentes']) AS s) LEFT JOIN (SELECT id, CASE WHEN text_path IS NULL THEN 'pendentes' WHEN coalesce(scanned, false) THEN 'escaneados' ELSE 'extraidos' END AS b FROM docs) b ON b.b = s GROUP BY 1")
on_catalog("multi_version_share", C.multi_version_share, "SELECT count(*) AS n_calls, count(*) FILTER (n > 1) AS n_multi, round(CAST(100 * count(*) FILTER (n > 1) AS DOUBLE) / CAST(greatest(count(*), 1) AS DOUBLE), 1) AS pct FROM (SELECT call_id, count(*) AS n FROM docs GROUP BY 1)")
on_catalog(
    "pipeline_status",
    C.pipeline_status,
    "SELECT c.id AS candidate_id, c.url, c.kind, CASE WHEN d.id IS NOT NULL THEN '✔' ELSE '–' END AS baixado, CASE WHEN d.text_path IS NOT NULL THEN '✔' ELSE '–' END AS textuado, CASE WHEN d.accepted_year IS NOT NULL THEN '✔' ELSE '–' END AS datado, CASE WHEN k.kind IS NOT NULL THEN '✔' ELSE '–' END AS classificado, CASE WHEN k.axis3 IS NULL THEN '–' WHEN k.axis3 = 'AUSENTE_SILENCIAMENTO' THEN 'silêncio' ELSE k.axis3 END AS eixo3 FROM candidates c LEFT JOIN docs d ON d.url = c.url LEFT JOIN classifications k ON k.url = c.url",
)
on_catalog("axis3_status", lambda c: C.axis3_status(c), "SELECT axis3, count(*) AS n FROM classifications WHERE axis3 IS NOT NULL AND url IN (SELECT url FROM docs) GROUP BY 1")
on_catalog("axis3_status_institution", lambda c: C.axis3_status(c, "NATION_7"), "SELECT axis3, count(*) AS n FROM classifications WHERE axis3 IS NOT NULL AND url IN (SELECT url FROM docs WHERE call_id IN (SELECT id FROM calls WHERE institution_id IN (SELECT id FROM institutions WHERE upper(code) = 'NATION_7'))) GROUP BY 1")
AXIS_SHARE = ", ".join(f"round(CAST(100 * count(*) FILTER (k.axis3 = '{x}') AS DOUBLE) / CAST(count(*) AS DOUBLE), 1) AS \"{x}\"" for x in CODES)
on_catalog("axis3_by_institution", lambda c: C.axis3_shares(c, "institution", CODES), f"SELECT institution, {AXIS_SHARE} FROM base JOIN classifications k ON k.url = base.url WHERE k.axis3 IS NOT NULL GROUP BY 1")
on_catalog("axis3_by_year", lambda c: C.axis3_shares(c, "year", CODES), f"SELECT year, {AXIS_SHARE} FROM base JOIN classifications k ON k.url = base.url WHERE k.axis3 IS NOT NULL GROUP BY 1")
on_catalog("latest_version", lambda c: C.latest_version(c.documents), "SELECT url, id, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY captured_at DESC, seq DESC) AS r FROM docs) WHERE r = 1")
on_catalog("to_classify", lambda c: C.to_classify(c).select("id", "url", "portal_id", "anchor", "excluded"), "SELECT d.id, d.url, c.portal_id, c.anchor, coalesce(f.excluded, false) AS excluded FROM docs d JOIN (SELECT url, max(anchor) AS anchor, min(portal_id) AS portal_id FROM candidates WHERE kind = 'pdf' GROUP BY 1) c ON c.url = d.url LEFT JOIN decisions f ON f.url = d.url")
on_catalog("review_queue", lambda c: C.review_queue(c, "pendente", 100), "SELECT q.id, q.url, q.status, p.category, i.code AS institution FROM queue q JOIN portals p ON p.id = q.portal_id JOIN institutions i ON i.id = p.institution_id WHERE q.status = 'pendente' ORDER BY q.id LIMIT 100")
on_catalog("portal_documents", lambda c: c.documents.join(c.candidates.where((F.col("portal_id") == 3) & (F.col("kind") == "pdf")).select("url"), "url", "left_semi").select("id", "url"), "SELECT id, url FROM docs WHERE url IN (SELECT DISTINCT url FROM candidates WHERE portal_id = 3 AND kind = 'pdf')")
on_catalog("custody", lambda c: C.custody(c).select("call_id", F.size("documents").cast("long").alias("n"), F.array_join(F.transform("documents", lambda d: d["id"].cast("string")), ",").alias("ids"), F.array_join(F.transform("documents", lambda d: F.coalesce(d["queue"]["queue_id"].cast("string"), F.lit("-"))), ",").alias("queue_ids")), "SELECT call_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY captured_at, seq) AS ids, string_agg(coalesce(CAST(queue_id AS VARCHAR), '-'), ',' ORDER BY captured_at, seq) AS queue_ids FROM docs LEFT JOIN decisions USING (url) GROUP BY 1")
on_table("latest_events", "events", lambda e: C.latest(e, 20).select("event_id", "event_type", "user_id"), "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 20")
on_table(
    "same_hash_alias",
    "documents",
    lambda d: C.first_same_hash(d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("url"), F.col("source").alias("portal_id"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("seq"))),
    "WITH h AS (SELECT doc_id, source, sha256(text) AS h FROM documents), f AS (SELECT a.doc_id, min(b.doc_id) AS o FROM h a JOIN h b ON a.h = b.h AND a.source = b.source AND a.doc_id <> b.doc_id GROUP BY 1) SELECT doc_id AS id, doc_id AS url, o AS alias_of FROM f",
)

# ---- upserts and stages ----------------------------------------------------------------------------------------


def _old_new(c: C.Catalog) -> tuple[DataFrame, DataFrame]:
    rows = c.candidates.select("id", "url", "portal_id", F.when(F.col("id") % 2 == 0, F.col("anchor")).alias("anchor"))
    old = rows.where("id % 3 = 0").groupBy("portal_id", "url").agg(F.min_by(F.struct("id", "anchor"), "id").alias("r")).select("r.id", "url", "portal_id", "r.anchor")
    return old, rows.where("id % 3 <> 0")


OLD_NEW = ", r AS (SELECT id, url, portal_id, CASE WHEN id % 2 = 0 THEN anchor END AS anchor FROM candidates), old AS (SELECT portal_id, url, min(id) AS id, arg_min({a: anchor}, id).a AS anchor FROM r WHERE id % 3 = 0 GROUP BY 1, 2), new AS (SELECT portal_id, url, min(id) AS id, arg_min({a: anchor}, id).a AS anchor FROM r WHERE id % 3 <> 0 GROUP BY 1, 2) "
on_catalog("candidate_upsert", lambda c: stages.fill_nulls(*_old_new(c), ["portal_id", "url"], ["anchor"], ["id"]), OLD_NEW + "SELECT coalesce(o.id, n.id) AS id, url, portal_id, coalesce(o.anchor, n.anchor) AS anchor, o.id IS NULL AS inserted FROM old o FULL JOIN new n USING (portal_id, url)")
on_catalog("insert_or_ignore", lambda c: stages.insert_or_ignore(*_old_new(c), ["portal_id", "url"], ["id"]), OLD_NEW + "SELECT id, url, portal_id, anchor FROM old UNION ALL SELECT id, url, portal_id, anchor FROM new WHERE (portal_id, url) NOT IN (SELECT (portal_id, url) FROM old)")
on_catalog("insert_or_replace", lambda c: stages.insert_or_replace(*_old_new(c), ["portal_id", "url"], ["id"]), OLD_NEW + ", last AS (SELECT portal_id, url, max(id) AS id, arg_max({a: anchor}, id).a AS anchor FROM r WHERE id % 3 <> 0 GROUP BY 1, 2) SELECT id, url, portal_id, anchor FROM last UNION ALL SELECT id, url, portal_id, anchor FROM old WHERE (portal_id, url) NOT IN (SELECT (portal_id, url) FROM last)")
on_catalog("queue_enqueue", lambda c: stages.enqueue(c.queue.select("id", "url", "status"), c.documents.select((F.col("id") + 1_000_000_000).alias("id"), "url")), "SELECT id, url, status FROM queue UNION ALL SELECT min(id) + 1000000000, url, 'pendente' FROM docs WHERE url NOT IN (SELECT url FROM queue WHERE status = 'pendente') GROUP BY url")
on_catalog("resume_guard", lambda c: stages.remaining(c.documents.select("id", "url"), c.classifications, ["url"]), "SELECT id, url FROM docs WHERE url NOT IN (SELECT url FROM classifications)")
on_catalog("sweep_transition", lambda c: stages.transition(c.queue.select("id", F.when(F.col("status") == "pendente", "pendente").otherwise("concluida").alias("status")), "iniciar"), "SELECT id, CASE WHEN status = 'pendente' THEN 'rodando' ELSE 'concluida' END AS status, status = 'pendente' AS moved FROM queue")
on_catalog(
    "queue_decisions",
    lambda c: stages.decide(c.queue, c.queue.select("id", F.when(F.col("id") % 2 == 0, 2023).alias("year"), (F.col("id") % 3 == 0).alias("exclude"), F.lit("motivo").alias("justification"), F.when(F.col("id") % 5 != 0, "autora").alias("author")))[0].select("id", "status", "decided_year", "excluded"),
    ", ok AS (SELECT id, CASE WHEN id % 2 = 0 THEN 2023 END AS y, id % 3 = 0 AS x FROM queue WHERE status = 'pendente' AND (id % 2 = 0) <> (id % 3 = 0) AND id % 5 <> 0) SELECT q.id, CASE WHEN ok.id IS NULL THEN status ELSE 'resolvida' END AS status, CASE WHEN ok.id IS NULL THEN decided_year ELSE y END AS decided_year, CASE WHEN ok.id IS NULL THEN excluded ELSE x END AS excluded FROM queue q LEFT JOIN ok ON ok.id = q.id",
)
on_catalog("catalogue_sync", lambda c: stages.sync(c.institutions.select("code", F.col("id").alias("v")), c.institutions.select(F.concat(F.lower("code"), F.when(F.col("id") % 5 == 0, "x").otherwise("")).alias("code"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 100).alias("v")), "code"), ", a AS (SELECT code, id AS v FROM institutions), b AS (SELECT lower(code) || CASE WHEN id % 5 = 0 THEN 'x' ELSE '' END AS code, CASE WHEN id % 2 = 0 THEN id ELSE id + 100 END AS v FROM institutions) SELECT coalesce(a.code, b.code) AS code, coalesce(b.v, a.v) AS v, CASE WHEN a.code IS NULL THEN 'criado' WHEN b.code IS NULL THEN 'ausente' WHEN a.v = b.v THEN 'inalterado' ELSE 'atualizado' END AS action FROM a FULL JOIN b ON upper(a.code) = upper(b.code)")
on_catalog(
    "capture_decision",
    lambda c: stages.captures(c.documents.select("id", "url", "hash", "seq", (F.col("call_id") % 10).alias("portal_id"))).select("id", "action", "refers_to"),
    ", x AS (SELECT id, url, hash, seq, call_id % 10 AS portal_id FROM docs), y AS (SELECT *, lag(hash) OVER (PARTITION BY url ORDER BY seq) AS b, first(url) OVER (PARTITION BY portal_id, hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM x), z AS (SELECT *, CASE WHEN b = hash THEN 'restaurado' WHEN b IS NOT NULL THEN 'nova_versao' WHEN f IS NOT NULL THEN 'alias' ELSE 'novo' END AS action FROM y) SELECT id, action, CASE WHEN action = 'alias' THEN f END AS refers_to FROM z",
)
on_catalog("duplicate_urls", lambda c: stages.duplicates(c.documents, "url"), "SELECT url, count(*) AS n FROM docs GROUP BY 1 HAVING count(*) > 1")
on_table("log_entries", "events", lambda e: eventlog.log_entries(e, "event_id", "props"), "SELECT event_id, k AS etapa, CAST(json_extract_string(props, k) AS VARCHAR) AS valor FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
RUNS = "WITH h AS (SELECT *, CAST(event_type = 'error' AS INT) AS hit FROM events), i AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM h), r AS (SELECT *, sum(hit) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS run FROM i) "
on_table("consecutive_403", "events", lambda e: rules.consecutive(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "run"), RUNS + "SELECT event_id, CAST(run AS BIGINT) AS run FROM r")
on_table("suspended_hosts", "events", lambda e: rules.suspended(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error"), RUNS + "SELECT user_id, CAST(max(run) AS BIGINT) AS longest FROM r GROUP BY 1 HAVING max(run) >= 3")

# ---- URLs and years --------------------------------------------------------------------------------------------

HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\.', '')"
on_table(
    "url_normalize",
    "pages",
    lambda p: p.select("page_id", urls.canonical(F.col("url")).alias("canonical")),
    r"""WITH q AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')) AS a FROM pages)
SELECT page_id, s || '://' || h || p || CASE WHEN len(a) = 0 THEN '' ELSE '?' || array_to_string(a, '&') END AS canonical FROM q""",
)
query("host_scope", f"WITH p AS (SELECT page_id, url, {HOST} AS host FROM pages), o AS (SELECT DISTINCT page_id % 7 AS portal_id, host FROM p WHERE page_id % 3 = 0), j AS (SELECT p.page_id, p.url, count(o.portal_id) AS n_portals, min(o.portal_id) AS f FROM p LEFT JOIN o ON o.host = p.host GROUP BY 1, 2) SELECT page_id, url, n_portals, CASE WHEN n_portals = 1 THEN f END AS portal_id, CASE n_portals WHEN 0 THEN 'fora_do_escopo' WHEN 1 THEN 'ok' ELSE 'ambiguo' END AS status FROM j", base=False)(
    lambda spark, d: (lambda p: stages.host_scope(p.select("page_id", "url"), p.where("page_id % 3 = 0").groupBy((F.col("page_id") % 7).alias("portal_id")).agg(F.collect_set("url").alias("urls"))))(model.table(spark, d, "pages"))
)
on_table("slug", "pages", lambda p: p.select("page_id", urls.slug(F.col("url")).alias("slug")), r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(list_last(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'documento') AS slug FROM pages")
on_table(
    "link_classify",
    "documents",
    lambda t: t.select("doc_id", urls.link_class(F.col("text"), F.concat(F.lit("https://h.org/"), F.element_at(F.array(*[F.lit(x) for x in ("editais", "chamada-x", "docs", "a/b.pdf", "noticias")]), (F.col("doc_id") % 5 + 1).cast("int")), F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise("/1")), keywords=("the", "is")).alias("class")),
    r"WITH d AS (SELECT doc_id, 'https://h.org/' || ['editais', 'chamada-x', 'docs', 'a/b.pdf', 'noticias'][1 + doc_id % 5] || CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '/1' END AS u, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+') AS w FROM documents) SELECT doc_id, CASE WHEN ends_with(u, '.pdf') THEN 'candidato/pdf' WHEN list_has_any(string_split_regex(u[14:], '[^a-z0-9]+'), ['edital', 'editais', 'chamada', 'chamadas']) THEN 'candidato/pagina_edital' WHEN list_has_any(w, ['the', 'is']) THEN 'secao' END AS class FROM d",
)
on_table("years_in_path", "orders", lambda o: o.select("o_orderkey", years.inside_path(u := F.concat(F.lit("http://x2020.org/"), (F.year("o_orderdate") + 20).cast("string"), F.lit("/d"), (F.year("o_orderdate") + 24).cast("string"), F.lit("?y=2021"))).alias("dentro"), years.outside_path(u).alias("fora"), years.provisional(u).alias("provisorio")), "WITH y AS (SELECT o_orderkey, CAST(list_sort(list_distinct([year(o_orderdate) + 20, year(o_orderdate) + 24])) AS INT[]) AS y FROM orders), z AS (SELECT o_orderkey, list_filter(y, lambda x: x BETWEEN 2019 AND 2026) AS dentro, list_filter(y, lambda x: x < 2019 OR x > 2026) AS fora FROM y) SELECT *, CASE WHEN len(dentro) = 1 THEN dentro[1] END AS provisorio FROM z")
on_table(
    "dating_decision",
    "orders",
    lambda o: (
        o.withColumn("y", (F.year("o_orderdate") + 24).cast("int"))
        .select("o_orderkey", F.create_map(F.lit("url"), F.when(F.col("o_orderkey") % 2 == 0, F.array("y")).otherwise(F.array().cast("array<int>")), F.lit("ancora"), F.when(F.col("o_orderkey") % 3 == 0, F.array("y")).otherwise(F.array().cast("array<int>")), F.lit("pdf_meta"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.col("y") + 1)).otherwise(F.array().cast("array<int>"))).alias("m"))
        .select("o_orderkey", rules.dating(F.col("m")).alias("d"))
        .select("o_orderkey", "d.year", "d.method", "d.reason")
    ),
    "WITH y AS (SELECT o_orderkey AS k, CAST(year(o_orderdate) + 24 AS INT) AS y FROM orders), n AS (SELECT *, k % 2 = 0 AS u, k % 3 = 0 AS a, k % 5 = 0 AS p FROM y) SELECT k AS o_orderkey, CASE WHEN a AND NOT p THEN y WHEN p AND NOT a AND NOT u THEN y + 1 END AS year, CASE WHEN a AND NOT p THEN CASE WHEN u THEN 'url' ELSE 'ancora' END WHEN p AND NOT a AND NOT u THEN 'pdf_meta' END AS method, CASE WHEN p AND (u OR a) THEN 'divergencia' WHEN NOT (u OR a OR p) THEN 'sem_data' WHEN u AND NOT a THEN 'baixa_confianca_sourl' END AS reason FROM n",
)
on_table("offpeak", "events", lambda e: e.select("event_id", years.off_peak(F.hour("ts") * 60 + F.minute("ts"), 22 * 60, 6 * 60).alias("off_peak")), "SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS off_peak FROM events")
on_table("scanned_flag", "documents", lambda d: d.select("doc_id", rules.scanned(F.col("n_chars"), F.size(F.split("text", "\n"))).alias("scanned")), "SELECT doc_id, n_chars < 100 * greatest(len(string_split(text, chr(10))), 1) AS scanned FROM documents")

# ---- text mining -----------------------------------------------------------------------------------------------


def ngram_sql(low: int, high: int) -> str:
    joined = lambda n: "t" + "".join(f" || ' ' || lead(t, {k}) OVER d" for k in range(1, n))
    parts = [f"SELECT doc_id, institution, year, {joined(n)} AS term FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)" for n in range(low, high + 1)]
    return ", words AS (SELECT doc_id, institution, year, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM toks), terms AS (SELECT * FROM (" + " UNION ALL ".join(parts) + r") WHERE term IS NOT NULL AND NOT regexp_matches(term, '\p{Nd}')) "


for _low, _high in ((1, 1), (1, 2), (1, 3), (2, 2)):
    _name = "term_freq_" + (f"{_high}gram" if _low == 1 else "2gram_only")
    on_corpus(_name, lambda c, r=(_low, _high): mining.term_frequency(c, r, 2, STOP), ngram_sql(_low, _high) + "SELECT term, count(*) AS freq FROM terms GROUP BY 1 HAVING count(*) >= 2")
on_corpus("top_terms", lambda c: mining.top_terms(mining.term_frequency(c, (1, 1), 2, STOP), 30), ngram_sql(1, 1) + "SELECT term, count(*) AS freq FROM terms GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
on_corpus("term_lookup", lambda c: mining.term_lookup(mining.term_frequency(c, (1, 2), 2, STOP), "Was  by", (1, 2)), ngram_sql(1, 2) + "SELECT term, count(*) AS freq FROM terms WHERE term = 'was by' GROUP BY 1 HAVING count(*) >= 2")
on_corpus("term_year_heatmap", lambda c: mining.term_heatmap(c, "year", 20, stopwords=STOP), ngram_sql(1, 1) + ", top AS (SELECT term, count(*) AS f FROM terms GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20) SELECT y.year, top.term, count(t.term) AS freq FROM top CROSS JOIN (SELECT DISTINCT year FROM corpus) y LEFT JOIN terms t ON t.term = top.term AND t.year = y.year GROUP BY 1, 2")
on_corpus("top_terms_per_group", lambda c: mining.top_terms_by(c, "institution", 15, stopwords=STOP), ngram_sql(1, 1) + ", f AS (SELECT institution, term, count(*) AS freq FROM terms GROUP BY 1, 2 HAVING count(*) >= 2) SELECT institution, term, freq FROM (SELECT *, row_number() OVER (PARTITION BY institution ORDER BY freq DESC, term) AS r FROM f) WHERE r <= 15")
VOCABULARY = ("the", "and", "of", "that", "with", "this", "is", "was", "from", "by", "to", "in")
on_corpus(
    "cooccurrence",
    lambda c: mining.cooccurrence(c, VOCABULARY, 10, 2),
    f""", k AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), ' '), lambda x: x IN {VOCABULARY}) AS w FROM corpus), i AS (SELECT doc_id, w[i] AS t, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM k))
SELECT least(a.t, b.t) AS t1, greatest(a.t, b.t) AS t2, count(*) AS n FROM i a JOIN i b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 10 AND a.t <> b.t GROUP BY 1, 2 HAVING count(*) >= 2""",
)
on_corpus(
    "top_pairs",
    lambda c: reports.top_pairs(mining.cooccurrence(c, VOCABULARY, 10, 2)),
    f""", k AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), ' '), lambda x: x IN {VOCABULARY}) AS w FROM corpus), i AS (SELECT doc_id, w[i] AS t, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM k))
SELECT least(a.t, b.t) AS t1, greatest(a.t, b.t) AS t2, count(*) AS n FROM i a JOIN i b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 10 AND a.t <> b.t GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
)
on_corpus(
    "kwic",
    lambda c: mining.concordance(c, "tion the", 50, None),
    r""", t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS t FROM corpus), h AS (SELECT doc_id, t, p FROM (SELECT doc_id, t, unnest(range(0, length(t))) AS p FROM t WHERE contains(t, 'tion the')) WHERE substr(t, p + 1, 8) = 'tion the')
SELECT doc_id, CAST(p AS INT) AS posicao, substr(t, greatest(p - 50, 0) + 1, least(p, 50)) || '**tion the**' || substr(t, p + 9, 50) AS trecho FROM h""",
)
FOLD = r"trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'), ' ')"
SIGNAL_SQL = f""", t AS (SELECT doc_id, institution, year, {FOLD} AS t FROM corpus), m AS (SELECT doc_id, institution, year, d.dimension, list_filter(d.s, lambda s: regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || s || '($|[^\\p{{L}}\\p{{N}}_])')) AS f FROM t, (SELECT unnest([{{'dimension': 'artigos', 's': ['the', 'that']}}, {{'dimension': 'preposicoes', 's': ['of the', 'with', 'from']}}, {{'dimension': 'verbos', 's': ['is', 'was', 'are']}}]) AS d)) """
on_corpus("signal_mining", lambda c: mining.signals(c, DIMENSIONS), SIGNAL_SQL + "SELECT doc_id, dimension, CAST(len(f) AS INT) AS n, array_to_string(f, ', ') AS sinais FROM m")
on_corpus("dimension_prevalence", lambda c: mining.prevalence(mining.signals(c, DIMENSIONS, by=["institution"]), ["institution"]), SIGNAL_SQL + "SELECT institution, dimension, round(avg(CASE WHEN len(f) > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 1) AS pct, count(*) AS n_docs FROM m GROUP BY 1, 2")
on_corpus("dimension_by_year", lambda c: mining.prevalence(mining.signals(c, DIMENSIONS, by=["year"]), ["year"]), SIGNAL_SQL + "SELECT year, dimension, round(avg(CASE WHEN len(f) > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 1) AS pct, count(*) AS n_docs FROM m GROUP BY 1, 2")
on_corpus("signal_hits", lambda c: mining.signal_hits(c, ["worthless", "pathetic"], "institution"), r""", t AS (SELECT doc_id, institution, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS t FROM corpus), h AS (SELECT s AS signal, doc_id, institution, p FROM (SELECT s, doc_id, institution, t, unnest(range(0, length(t))) AS p FROM t, (SELECT unnest(['worthless', 'pathetic']) AS s) WHERE contains(t, s)) WHERE substr(t, p + 1, length(s)) = s), c AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY doc_id, p) AS r FROM h) SELECT signal, institution, count(*) AS n FROM c WHERE r <= 500 GROUP BY 1, 2""")
on_corpus("fulltext_search", lambda c: mining.search(c, "LICENSE").select("doc_id"), "SELECT doc_id FROM corpus WHERE contains(lower(text), 'license')")
on_corpus(
    "tfidf",
    lambda c: mining.tfidf(c, 1500, 2, 0.9, STOP).select("doc_id", "term", F.round("weight", 6).alias("weight")),
    ngram_sql(1, 1) + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM corpus), s AS (SELECT term, count(*) AS df, sum(tf) AS a FROM tf GROUP BY 1), v AS (SELECT term, ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM s, n WHERE df >= 2 AND df <= n * CAST(0.9 AS DOUBLE) ORDER BY a DESC, term LIMIT 1500), w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN v USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1) SELECT doc_id, term, round(w / l, 6) AS weight FROM w JOIN l USING (doc_id)",
)
on_corpus(
    "tfidf_neighbours",
    lambda c: neighbours.neighbours(mining.tfidf(c, 1500, 2, 0.9, STOP), 10),
    ORACLES["tfidf"].removeprefix(model.SQL).replace("SELECT doc_id, term, round(w / l, 6) AS weight FROM w JOIN l USING (doc_id)", ", u AS (SELECT doc_id, term, w / l AS w FROM w JOIN l USING (doc_id)), c AS (SELECT a.doc_id, b.doc_id AS other, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2) SELECT doc_id, CAST(rank AS INT) AS rank, other, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, other) AS rank FROM c WHERE cosine > 0) WHERE rank <= 10"),
)


def _projection_sql(steps: int = 60) -> str:
    """Two axes by repeated multiplication, the second kept square to the first; the sign as the operator has it."""
    parts = [ORACLES["tfidf"].removeprefix(model.SQL).replace("SELECT doc_id, term, round(w / l, 6) AS weight FROM w JOIN l USING (doc_id)", ", u AS MATERIALIZED (SELECT doc_id, term, w / l AS w FROM w JOIN l USING (doc_id)), c AS MATERIALIZED (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM u), mu AS MATERIALIZED (SELECT term, sum(w) / n AS m FROM u, c GROUP BY term, n), z0 AS MATERIALIZED (SELECT term, CAST(1 AS DOUBLE) / row_number() OVER (ORDER BY term) AS x FROM mu)")]
    before = "z0"
    for axis in ("p", "q"):
        for k in range(steps):
            parts.append(f"{axis}y{k} AS MATERIALIZED (SELECT doc_id, sum(w * x) AS y FROM u JOIN {before} USING (term) GROUP BY 1), {axis}m{k} AS MATERIALIZED (SELECT sum(m * x) AS s FROM mu JOIN {before} USING (term))")
            parts.append(f"{axis}r{k} AS MATERIALIZED (SELECT term, sum(w * y) - any_value(n * m * s) AS x FROM u JOIN {axis}y{k} USING (doc_id) JOIN mu USING (term), c, {axis}m{k} GROUP BY 1)")
            flat = f"{axis}r{k}"
            if axis == "q":
                parts.append(f"qd{k} AS MATERIALIZED (SELECT sum(a.x * b.x) AS s FROM qr{k} a JOIN p{steps - 1} b USING (term)), qf{k} AS MATERIALIZED (SELECT term, a.x - s * b.x AS x FROM qr{k} a JOIN p{steps - 1} b USING (term), qd{k})")
                flat = f"qf{k}"
            parts.append(f"{axis}{k} AS MATERIALIZED (SELECT term, x / l AS x FROM {flat}, (SELECT sqrt(sum(x * x)) AS l FROM {flat}))")
            before = f"{axis}{k}"
        before = "z0"
    turned = ", ".join(f"{a}s AS (SELECT term, x * CASE WHEN (SELECT arg_max(x, abs(x)) FROM {a}{steps - 1}) < 0 THEN -1 ELSE 1 END AS x FROM {a}{steps - 1})" for a in "pq")
    return ", ".join([*parts, turned]) + " SELECT doc_id, round(sum(w * ps.x), 4) AS x, round(sum(w * qs.x), 4) AS y FROM u JOIN ps USING (term) JOIN qs USING (term) GROUP BY 1"


on_corpus("tfidf_projection", lambda c: mining.project_2d(mining.tfidf(c, 1500, 2, 0.9, STOP)).select("doc_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")), _projection_sql())

# ---- rules and coding ------------------------------------------------------------------------------------------

on_corpus(
    "l1_classify",
    lambda c: rules.classify(c.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("text"), F.col("text").alias("anchor")), SIGNALS, {"x": ("worthless", "the idiot"), "y": ("worthless", "license")}).select("doc_id", "kind", "method", F.array_join("signals", ",").alias("sinais"), F.array_join("dimensions", ",").alias("dims"), "anchor_evidence"),
    r""", t AS (SELECT doc_id, text, doc_id % 5 <> 0 AND regexp_matches(text, '\S') AS h, """ + FOLD.replace("text", "text") + r""" AS t, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g'), ' ') AS a FROM corpus), m AS (SELECT doc_id, h, text, list_filter(['worthless', 'pathetic', 'the idiot', 'license'], lambda s: h AND regexp_matches(t, '(^|[^\p{L}\p{N}_])' || s || '($|[^\p{L}\p{N}_])')) AS t, list_filter(['worthless', 'pathetic', 'the idiot', 'license'], lambda s: regexp_matches(a, '(^|[^\p{L}\p{N}_])' || s || '($|[^\p{L}\p{N}_])')) AS a FROM t), u AS (SELECT *, CASE WHEN len(t) > 0 THEN t ELSE a END AS s FROM m)
SELECT doc_id, CASE WHEN len(s) > 0 THEN 'inovacao' WHEN h THEN 'nao_inovacao' ELSE 'sem_texto' END AS kind, CASE WHEN len(t) > 0 THEN 'texto' WHEN len(a) > 0 THEN 'ancora' WHEN h THEN 'texto' ELSE 'sem_texto' END AS method, array_to_string(s, ',') AS sinais,
CASE WHEN list_contains(s, 'worthless') THEN 'x,y' WHEN list_contains(s, 'the idiot') AND list_contains(s, 'license') THEN 'x,y' WHEN list_contains(s, 'the idiot') THEN 'x' WHEN list_contains(s, 'license') THEN 'y' ELSE '' END AS dims,
CASE WHEN len(t) = 0 AND len(a) > 0 THEN substr(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 160) END AS anchor_evidence FROM u""",
)
on_corpus(
    "axis3_classify",
    lambda c: c.select("doc_id", rules.axis3(F.col("text"), ("worthless", "pathetic"), ("idiot", "clown"), ("the", "license"), ("clown",)).alias("r")).select("doc_id", "r.code", F.array_join("r.signals", ",").alias("sinais")),
    f""", t AS (SELECT doc_id, {FOLD} AS t FROM corpus), h AS (SELECT doc_id, list_filter(['worthless', 'pathetic', 'idiot', 'clown', 'the', 'license'], lambda s: regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])' || s || '($|[^\\p{{L}}\\p{{N}}_])')) AS f FROM t), p AS (SELECT doc_id, f, list_filter(f, lambda x: x IN ('worthless', 'pathetic'))[1] AS g, list_filter(f, lambda x: x IN ('idiot', 'clown'))[1] AS a FROM h)
SELECT doc_id, CASE WHEN g IS NOT NULL AND a IS NOT NULL THEN 'IMPACTO_SUBSTANTIVO' WHEN list_contains(f, 'the') AND list_contains(f, 'license') AND NOT list_contains(f, 'clown') THEN 'IMPACTO_INSTRUMENTAL' ELSE 'AUSENTE_SILENCIAMENTO' END AS code, CASE WHEN g IS NOT NULL AND a IS NOT NULL THEN g || ',' || a WHEN list_contains(f, 'the') AND list_contains(f, 'license') AND NOT list_contains(f, 'clown') THEN 'the,license' ELSE '' END AS sinais FROM p""",
)
CITATION = r"""WITH q AS (SELECT item_id AS quote_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'), ' ') AS needle FROM benchmark),
t AS (SELECT doc_id, text, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'), ' ') AS folded FROM documents),
h AS (SELECT quote_id, doc_id, text, strpos(folded, needle) AS spot FROM t, q WHERE needle <> '' AND contains(folded, needle)),
p AS (SELECT quote_id, doc_id, spot, unnest(string_split(text, chr(10))) AS page, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM h),
l AS (SELECT *, length(trim(regexp_replace(replace(lower(page), 'ß', 'ss'), '\s+', ' ', 'g'), ' ')) AS l FROM p),
e AS (SELECT *, sum(CASE WHEN l > 0 THEN l + 1 ELSE 0 END) OVER (PARTITION BY quote_id, doc_id ORDER BY n) - 1 AS done FROM l)
SELECT quote_id, doc_id, CAST(min(n) FILTER (done >= spot) AS INT) AS page FROM e GROUP BY 1, 2"""
query("citation_check", CITATION, base=False)(lambda spark, d: citations.hits(model.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), model.table(spark, d, "documents")))

BOOK = coding.Codebook([coding.Field("qualidade", ordinal=(0, 1)), coding.Field("tom", labels=("toxico", "neutro"), allows_na=True)])


def _answers(labels: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 6
    quote = F.when(k == 1, " ").otherwise("trecho")
    tone = F.when(k == 2, "N/A").when(k == 3, "alegre").when(F.col("toxic") == 1, "toxico").otherwise("neutro")
    part = lambda v, q: F.concat(F.lit('{"valor": '), v, F.lit(', "citacao_documento": '), F.when((k == 2) & (q == 2), "null").otherwise(F.lit('"d1"')), F.lit(', "citacao_trecho": '), F.when((k == 2) & (q == 2), "null").otherwise(F.concat(F.lit('"'), quote, F.lit('"'))), F.lit("}"))
    body = F.concat(F.lit('{"campos": {"qualidade": '), part(F.col("quality").cast("string"), F.lit(1)), F.when(k == 4, "").otherwise(F.concat(F.lit(', "tom": '), part(F.concat(F.lit('"'), tone, F.lit('"')), F.lit(2)))), F.lit("}}"))
    return labels.select("doc_id", F.when(k == 5, "nada").otherwise(F.concat(F.lit("resposta: "), body)).alias("raw"))


on_table(
    "l2_validate",
    "labels",
    lambda t: _answers(t).select("doc_id", F.array_join(coding.problems(F.col("raw"), BOOK, F.array(F.lit("d1"))), "; ").alias("problems")),
    "SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN 'raiz invalida' WHEN 4 THEN 'falta tom' WHEN 3 THEN 'tom: valor invalido' WHEN 1 THEN 'qualidade: sem trecho; tom: sem trecho' ELSE '' END AS problems FROM labels",
)
on_catalog(
    "batch_lookup_nullsafe",
    lambda c: coding.match_batches(c.queue.select(F.when(F.col("id") % 5 != 0, F.col("id") % 7).alias("seed"), (F.col("id") % 3).alias("model")).distinct(), c.queue.select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 7).alias("seed"), (F.col("id") % 3).alias("model"), F.when(F.col("id") % 10 == 0, "aberto").otherwise("concluido").alias("status")), ["seed", "model"]),
    ", s AS (SELECT DISTINCT CASE WHEN id % 5 <> 0 THEN id % 7 END AS seed, id % 3 AS model FROM queue), b AS (SELECT id, CASE WHEN id % 4 <> 0 THEN id % 7 END AS seed, id % 3 AS model, id % 10 = 0 AS o FROM queue) SELECT s.seed, s.model, arg_max(b.id, CAST(o AS BIGINT) * 1000000000000 + b.id) AS batch_id FROM s JOIN b ON s.seed IS NOT DISTINCT FROM b.seed AND s.model = b.model GROUP BY 1, 2",
)
on_table("html_links", "pages", lambda p: p.select("page_id", F.size(urls.links(F.col("html"))).cast("long").alias("n_links")), "SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=\"[^\"]*\">')) AS BIGINT) AS n_links FROM pages")

# ---- status and dashboard --------------------------------------------------------------------------------------

SWEEPS = ", sweeps AS (SELECT o_orderkey AS id, 'https://s.org/' || o_orderkey AS url, o_orderkey % 10 + 1 AS portal_id, CASE o_orderstatus WHEN 'F' THEN 'concluida' WHEN 'O' THEN 'pendente' ELSE 'rodando' END AS status FROM orders), wide AS (SELECT base.*, coalesce(base.year, base.provisional_year, 0) AS ano, k.kind, k.axis3 FROM base LEFT JOIN classifications k ON k.url = base.url), coded AS (SELECT doc_id % 40 AS call_id, doc_id % 3 AS batch_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'citacao_invalidada' END AS verification FROM labels) "
PLACES, KINDS_WANTED, CODES_WANTED = ("NATION_1", "NATION_2", "NATION_3", "NATION_7"), ("inovacao", "nao_inovacao"), CODES[:2]


def _sweeps(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "concluida").when(F.col("o_orderstatus") == "O", "pendente").otherwise(reports.RUNNING)
    return model.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://s.org/"), F.col("o_orderkey").cast("string")).alias("url"), (F.col("o_orderkey") % 10 + 1).alias("portal_id"), status.alias("status"))


def _wide(c: C.Catalog) -> DataFrame:
    rows = C.base(c).join(c.classifications.select("url", "kind", "axis3"), "url", "left")
    return rows.withColumn("ano", F.coalesce("year", F.col("provisional_year").cast("int"), F.lit(0)))


def coded(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "labels").select((F.col("doc_id") % 40).alias("call_id"), (F.col("doc_id") % 3).alias("batch_id"), F.when(F.col("quality") == 1, "ok").otherwise("citacao_invalidada").alias("verification"))


on_catalog("table_totals", reports.totals, "SELECT 'instituicoes' AS name, count(*) AS n FROM institutions UNION ALL SELECT 'portais', count(*) FROM portals UNION ALL SELECT 'editais', count(*) FROM calls UNION ALL SELECT 'documentos', count(*) FROM docs")
on_catalog("queue_count", lambda c: reports.count_where(c.queue, status="pendente", portal_id=None), "SELECT count(*) AS n FROM queue WHERE status = 'pendente'")
query("sweeps_detail", SWEEPS + "SELECT s.id, s.url, s.status, s.portal_id, p.category, i.code AS institution FROM sweeps s JOIN portals p ON p.id = s.portal_id JOIN institutions i ON i.id = p.institution_id WHERE s.status = 'pendente'")(lambda spark, d: reports.sweeps(_sweeps(spark, d), model.catalog(spark, d), "pendente").select("id", "url", "status", "portal_id", "category", "institution"))
query("synthetic_portals", SWEEPS + "SELECT s.id AS sweep_id, i.code AS institution, p.category, s.url, s.url AS seeds FROM sweeps s JOIN portals p ON p.id = s.portal_id JOIN institutions i ON i.id = p.institution_id")(lambda spark, d: reports.synthetic_portals(reports.sweeps(_sweeps(spark, d), model.catalog(spark, d))).withColumn("seeds", F.array_join("seeds", " ")))
on_catalog("pipeline_flags", lambda c: reports.pipeline_flags(C.pipeline_status(c)), "SELECT count(*) FILTER (d.id IS NOT NULL) AS baixado, count(*) FILTER (d.text_path IS NOT NULL) AS textuado, count(*) FILTER (d.accepted_year IS NOT NULL) AS datado, count(*) FILTER (k.kind IS NOT NULL) AS classificado, count(*) FILTER (k.axis3 IS NOT NULL) AS eixo3 FROM candidates c LEFT JOIN docs d ON d.url = c.url LEFT JOIN classifications k ON k.url = c.url")
on_catalog("filter_stack", lambda c: reports.selected(_wide(c), PLACES, ("integra", "extensao", "outros"), (2019, 2024), KINDS_WANTED, CODES_WANTED).select("id", "institution", "category", "ano", "kind", "axis3"), SWEEPS + f"SELECT id, institution, category, ano, kind, axis3 FROM wide WHERE NOT excluded AND institution IN {PLACES} AND category IN ('integra', 'extensao', 'outros') AND ano BETWEEN 2019 AND 2024 AND kind IN {KINDS_WANTED} AND axis3 IN {CODES_WANTED}")
on_catalog("excluded_rows", lambda c: reports.excluded_selected(_wide(c), PLACES, ("integra", "extensao", "outros")).select("id", "institution", "category"), SWEEPS + f"SELECT id, institution, category FROM wide WHERE excluded AND institution IN {PLACES} AND category IN ('integra', 'extensao', 'outros')")
on_catalog("option_lists", lambda c: reports.options(_wide(c), "category"), SWEEPS + "SELECT DISTINCT category FROM wide WHERE category IS NOT NULL")
query("coded_calls", SWEEPS + "SELECT DISTINCT call_id FROM coded WHERE batch_id = 1")(lambda spark, d: reports.coded_calls(coded(spark, d), 1))
query("coding_summary", SWEEPS + "SELECT count(DISTINCT call_id) AS n_calls, count(*) FILTER (verification = 'ok') AS n_verified, (SELECT count(DISTINCT batch_id) FROM coded) AS n_batches FROM coded")(lambda spark, d: reports.coding_summary(coded(spark, d), coded(spark, d).select("batch_id").distinct()))
query("fresh_sweeps", "SELECT event_id, event_type = 'click' AND ts > (SELECT max(ts) FROM events) - INTERVAL 2 HOURS AS alive FROM events", base=False)(lambda spark, d: (lambda e: e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", reports.running_recently(F.when(F.col("event_type") == "click", reports.RUNNING).otherwise("pendente"), F.col("ts"), F.col("now")).alias("alive")))(model.table(spark, d, "events")))  # one row is sent
on_catalog("text_vigency", lambda c: c.documents.select("id", reports.text_is_current(F.col("captured_at"), F.col("text_path"), F.col("id") % 7 != 0, F.col("hash"), F.when(F.col("id") % 11 != 0, F.col("hash"))).alias("current")), "SELECT id, text_path IS NOT NULL AND id % 7 <> 0 AND id % 11 <> 0 AS current FROM docs")
on_catalog("shared_urls", lambda c: reports.shared_ids(c.documents, c.candidates, "url"), "SELECT url FROM docs INTERSECT SELECT url FROM candidates")
on_corpus("term_year_pivot", lambda c: reports.wide(mining.term_heatmap(c, "year", 20, stopwords=STOP), "term", "year", "freq", YEARS), ngram_sql(1, 1) + ", top AS (SELECT term, count(*) AS f FROM terms GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20) SELECT top.term, " + ", ".join(f'count(t.term) FILTER (t.year = {y}) AS "{y}"' for y in YEARS) + " FROM top LEFT JOIN terms t ON t.term = top.term GROUP BY 1")
on_catalog("n_docs_pivot", lambda c: C.coverage(c).groupBy("institution").pivot("ano", YEARS).agg(F.sum("n_docs")).na.fill(0), "SELECT institution, " + ", ".join(f'CAST(coalesce(sum(n_docs) FILTER (ano = {y}), 0) AS BIGINT) AS "{y}"' for y in YEARS) + " FROM coverage GROUP BY 1")
on_catalog("category_remap", lambda c: c.portals.select("id", reports.present_category(F.when(F.col("id") % 3 == 0, "prpgi_prppg").otherwise(F.col("category"))).alias("category")), "SELECT id, CASE WHEN id % 3 = 0 THEN 'prppg_inovacao' ELSE category END AS category FROM portals")
query("sql_with_parameters", "SELECT id, url FROM docs WHERE id > 100 AND call_id = 7")(lambda spark, d: reports.run_sql(spark, "SELECT id, url FROM {documentos} WHERE id > :least AND call_id = :call", {"documentos": model.catalog(spark, d).documents}, {"least": 100, "call": 7}))
query("file_urls", "SELECT o_orderkey, o_orderkey % 18 < 15 AS is_file FROM orders", base=False)(lambda spark, d: model.table(spark, d, "orders").select("o_orderkey", urls.is_file(F.concat(F.lit("https://h.org/x.y/f."), F.element_at(F.array(*[F.lit(x) for x in (*urls.BINARY_ENDINGS, "jpg", "html", "PNG")]), (F.col("o_orderkey") % 18 + 1).cast("int")), F.lit("?a=b.pdf"))).alias("is_file")))


def queries() -> dict[str, Query]:
    from folioscope import registry_stages  # noqa: F401  adds its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
