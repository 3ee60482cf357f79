"""Queries of the stages that read and write tables of their own, each with its DuckDB SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.operators import catalog, classifying, coding, dating, eventlog, joins, mining, rules, staged, stages
from folioscope.plans import model
from folioscope.registry import BOOK, DIMENSIONS, FOLD, SIGNAL_SQL, SIGNALS, STOP, YEARS, coded, ngram_sql, query
from folioscope.sources import files
from folioscope.sources.buckets import Buckets
from folioscope.sources.scratch import shared_folder

# ---- dating: evidence is planted into the pages' own columns --------------------------------------------------------


def dated_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and queue made from pages: years 2018 to 2027 in path, anchor, metadata and page.

    A page's number is spelt in letters in its URL: p2019 would be evidence of 2019 that nobody planted.
    """
    k = F.col("page_id")
    year = (2018 + k % 10).cast("string")
    say = lambda every, *parts: F.when(k % every == 0, F.concat(*parts))
    pages = model.table(spark, d, "pages")
    docs = pages.select(
        k.alias("id"),
        F.concat(F.lit("https://h.org/p"), F.translate(k.cast("string"), "0123456789", "abcdefghij"), F.coalesce(say(2, F.lit("/"), year), F.lit(""))).alias("url"),
        (k % 7).alias("portal_id"),
        say(3, F.lit("Edital "), year).alias("anchor"),
        say(4, F.lit("D:"), year, F.lit("0101")).alias("created"),
        F.lit(None).cast("string").alias("modified"),
        say(5, F.lit("Chamada "), (2019 + k % 10).cast("string")).alias("title"),
        (k % 11 != 0).alias("readable"),
        F.concat("html", F.coalesce(say(6, F.lit('<time datetime="'), year, F.lit('-05-01">x</time>')), F.lit(""))).alias("html"),
        F.when(k % 13 == 0, "url").alias("method"),
    )
    return docs, docs.where("id % 9 = 0").select((F.col("id") + 100_000).alias("id"), "url", "portal_id", F.lit("resolvida").alias("status"))


DATED = """WITH p AS (SELECT page_id AS id, 2018 + page_id % 10 AS y, page_id AS k FROM pages),
e AS (SELECT *, y BETWEEN 2019 AND 2026 AS i, y + 1 BETWEEN 2019 AND 2026 AS j FROM p),
s AS (SELECT *, k % 2 = 0 AND i AS u, k % 3 = 0 AND i AS a, k % 4 = 0 AND i AS m, k % 5 = 0 AND j AS t, k % 6 = 0 AND i AS h FROM e),
c AS (SELECT *, u OR a OR m OR h AS own, CASE WHEN k % 13 = 0 OR k % 9 = 0 THEN 'pulado' WHEN k % 11 = 0 THEN 'erro' END AS o FROM s),
r AS (SELECT *, CASE WHEN own AND t THEN 'divergencia' WHEN NOT own AND NOT t THEN 'sem_data' WHEN u AND NOT a AND NOT m AND NOT h THEN 'baixa_confianca_sourl' END AS reason FROM c),
f AS (SELECT *, coalesce(o, CASE WHEN reason IS NULL THEN 'aceito' ELSE 'fila' END) AS outcome FROM r)
"""
query(
    "dating_stage",
    DATED + "SELECT id, outcome, CAST(CASE WHEN outcome = 'aceito' THEN CASE WHEN t THEN y + 1 ELSE y END END AS INT) AS year, CASE WHEN outcome = 'aceito' THEN CASE WHEN u THEN 'url' WHEN a THEN 'ancora' WHEN m OR t THEN 'pdf_meta' ELSE 'time_tag' END END AS method, CASE WHEN outcome = 'fila' THEN reason END AS reason FROM f",
    base=False,
)(lambda spark, d: dating.judged(*dated_pages(spark, d)).select("id", "outcome", "year", "method", "reason"))
query("dating_queue", DATED + "SELECT id + 100000 AS id, 'resolvida' AS status, CAST(NULL AS VARCHAR) AS reason FROM f WHERE id % 9 = 0 UNION ALL SELECT (SELECT max(id) FROM f WHERE id % 9 = 0) + 100000 + row_number() OVER (ORDER BY id), 'pendente', reason FROM f WHERE outcome = 'fila'", base=False)(
    lambda spark, d: dating.date_documents(*dated_pages(spark, d)).queue.select("id", "status", "reason")
)

# ---- classification: two runs over a bucketed table, which was filled in part before --------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as documents: some without text, some excluded; the text is the anchor too."""
    k = F.col("doc_id")
    return model.corpus(spark, d).select(k.alias("id"), F.concat(F.lit("u/"), k.cast("string")).alias("url"), (k % 6).alias("portal_id"), F.when(k % 5 != 0, F.col("text")).alias("text"), F.col("text").alias("anchor"), (k % 17 == 0).alias("excluded"))


def _level1(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    table = Buckets(spark, shared_folder(spark), classifying.LEVEL1, ["url"], 16)
    none = F.array().cast("array<string>")
    table.add(docs.where("id % 4 = 0").select("url", F.lit("antes").alias("kind"), F.when(F.col("id") % 8 == 0, "texto").otherwise("sem_texto").alias("method"), none.alias("signals"), none.alias("dimensions"), F.lit(None).cast("string").alias("anchor_evidence")), ["url"])
    classifying.level1(classifying.aimed(docs, portal=2), table, SIGNALS, {"x": SIGNALS[:2]})
    classifying.level1(classifying.aimed(docs, sweep=docs.where("id % 2 = 1")), table, SIGNALS, {"x": SIGNALS[:2]})
    return table.read().select("url", "kind", "method", F.array_join("signals", ",").alias("signals"))


_HAS = lambda text, words: f"list_filter({list(words)}, lambda s: regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_])' || s || '($|[^\\p{{L}}\\p{{N}}_])'))"
query(
    "l1_stage",
    f""", t AS (SELECT doc_id AS k, 'u/' || doc_id AS url, doc_id % 5 <> 0 AND regexp_matches(text, '\\S') AS h, {_HAS(FOLD, SIGNALS)} AS s FROM corpus),
r AS (SELECT *, NOT k % 17 = 0 AND (k % 6 = 2 OR k % 2 = 1) AS run, k % 4 = 0 AS old, CASE WHEN len(s) > 0 THEN 'inovacao' WHEN h THEN 'nao_inovacao' ELSE 'sem_texto' END AS kind, CASE WHEN h THEN 'texto' WHEN len(s) > 0 THEN 'ancora' ELSE 'sem_texto' END AS method FROM t),
x AS (SELECT *, run AND NOT (old AND k % 8 = 0) AND NOT (old AND method = 'sem_texto') AS new FROM r)
SELECT url, CASE WHEN new THEN kind ELSE 'antes' END AS kind, CASE WHEN new THEN method WHEN k % 8 = 0 THEN 'texto' ELSE 'sem_texto' END AS method, CASE WHEN new THEN array_to_string(s, ',') ELSE '' END AS signals FROM x WHERE new OR old""",
)(_level1)

AXIS = {"triggers": ("worthless", "pathetic"), "targets": ("idiot", "clown"), "required": ("the", "license"), "vetoed": ("clown",)}


def _axis3(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    table = Buckets(spark, shared_folder(spark), classifying.AXIS3, ["url"], 16)
    table.add(docs.where("id % 4 = 0").select("url", F.when(F.col("id") % 8 == 0, "IMPACTO_INSTRUMENTAL").otherwise("AUSENTE_SILENCIAMENTO").alias("code"), F.lit("antes").alias("evidence")), ["url"])
    classifying.axis3(classifying.aimed(docs, every=True), table, **AXIS)
    classifying.axis3(classifying.aimed(docs, url="u/1"), table, **AXIS)
    return table.read()


def _window(signal: str) -> str:
    """The text around a signal's place in the folded text."""
    before = f"CAST(length(regexp_extract(t, '(?s)^(|.*?[^\\p{{L}}\\p{{N}}_]){signal}($|[^\\p{{L}}\\p{{N}}_])', 1)) AS BIGINT)"
    return f"trim(regexp_replace(substr(text, 1 + greatest({before} - 120, 0), least({before}, 120) + 120), '\\s+', ' ', 'g'), ' ')"


AXIS_SQL = f""", t AS (SELECT doc_id, text, replace({FOLD}, 'ß', 'ss') AS t FROM corpus), h AS (SELECT *, {_HAS("t", ("worthless", "pathetic", "idiot", "clown", "the", "license"))} AS f FROM t),
g AS (SELECT *, list_filter(f, lambda x: x IN ('worthless', 'pathetic'))[1] AS g, list_filter(f, lambda x: x IN ('idiot', 'clown'))[1] AS a, list_contains(f, 'the') AND list_contains(f, 'license') AND NOT list_contains(f, 'clown') AS i FROM h),
x AS (SELECT *, CASE WHEN g IS NOT NULL AND a IS NOT NULL THEN 'IMPACTO_SUBSTANTIVO' WHEN i THEN 'IMPACTO_INSTRUMENTAL' ELSE 'AUSENTE_SILENCIAMENTO' END AS code, CASE WHEN g IS NOT NULL AND a IS NOT NULL THEN CASE g WHEN 'worthless' THEN {_window('worthless')} ELSE {_window('pathetic')} END WHEN i THEN {_window('the')} ELSE '' END AS evidence FROM g) """
query(
    "axis3_stage",
    AXIS_SQL + ", r AS (SELECT doc_id AS k, code, evidence, doc_id % 4 = 0 AS old, doc_id % 17 <> 0 AND doc_id % 5 <> 0 AND NOT doc_id % 8 = 0 AND NOT (doc_id % 4 = 0 AND code = 'AUSENTE_SILENCIAMENTO') AS new FROM x) SELECT 'u/' || k AS url, CASE WHEN new THEN code WHEN k % 8 = 0 THEN 'IMPACTO_INSTRUMENTAL' ELSE 'AUSENTE_SILENCIAMENTO' END AS code, CASE WHEN new THEN evidence ELSE 'antes' END AS evidence FROM r WHERE new OR old",
)(_axis3)
query("stage_totals", ", t AS (SELECT doc_id AS k, text FROM corpus), x AS (SELECT k % 6 AS portal_id, CASE WHEN k % 17 = 0 THEN 'excluido' WHEN k % 3 = 0 THEN 'pendente' WHEN k % 2 = 0 THEN 'inovacao' ELSE 'nao_inovacao' END AS result FROM t) SELECT portal_id, result, count(*) AS n FROM x GROUP BY 1, 2")(
    lambda spark, d: (lambda docs: classifying.totals(docs, docs.where("id % 3 <> 0").select("url", F.when(F.col("id") % 2 == 0, "inovacao").otherwise("nao_inovacao").alias("kind")), "kind"))(_documents(spark, d))
)



def _staged(spark: SparkSession, d: str) -> DataFrame:
    """Both classifications over one sweep, then a stage that fails and one that is not run; what the tables hold then."""
    docs = _documents(spark, d)
    first, third = Buckets(spark, shared_folder(spark), classifying.LEVEL1, ["url"], 16), Buckets(spark, shared_folder(spark), classifying.AXIS3, ["url"], 16)
    steps = [("classificar", lambda x: classifying.level1(x, first, SIGNALS, {})), ("eixo3", lambda x: classifying.axis3(x, third, **AXIS)), ("falha", lambda x: x.select("nada").count()), ("depois", lambda x: third.add(x.select("url", F.lit("x").alias("code"), F.lit("").alias("evidence")), ["url"]))]
    made = spark.createDataFrame([(s.name, s.status) for s in staged.run(lambda: docs, docs.where("id % 2 = 1"), steps)], "stage string, status string")
    held = first.read().select(F.lit("classificar").alias("stage")).unionByName(third.read().select(F.lit("eixo3").alias("stage"))).groupBy("stage").agg(F.count("*").alias("n"))
    return made.join(held, "stage", "left").select("stage", "status", F.coalesce("n", F.lit(0)).alias("n"))


query("staged_run", ", t AS (SELECT doc_id AS k, text FROM corpus WHERE doc_id % 2 = 1 AND doc_id % 17 <> 0) SELECT 'classificar' AS stage, 'concluido' AS status, count(*) AS n FROM t UNION ALL SELECT 'eixo3', 'concluido', count(*) FILTER (k % 5 <> 0 AND text IS NOT NULL) FROM t UNION ALL SELECT 'falha', 'falhou', 0 UNION ALL SELECT 'depois', 'nao_executado', 0")(_staged)
query("reachable_hosts", "WITH h AS (SELECT *, CAST(event_type = 'error' AS INT) AS hit FROM events), i AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM h), r AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, isl, sum(hit) AS n FROM i GROUP BY 1, 2) GROUP BY 1) SELECT event_id, e.user_id FROM events e JOIN r USING (user_id) WHERE longest < 3", base=False)(
    lambda spark, d: (lambda e: rules.reachable(e, e, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id"))(model.table(spark, d, "events"))
)

# ---- second-level coding: a deterministic client that refuses some calls now and then --------------------------------


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Three documents a call; some scanned, some without a current text."""
    marks = model.table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    k = F.col("doc_id")
    return model.table(spark, d, "documents").select("doc_id", "text").join(marks, "doc_id", "left").select(F.floor(k / 3).cast("long").alias("call_id"), "doc_id", k.alias("captured_at"), "text", ((k % 7 == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("scanned"), (k % 13 != 0).alias("current"))


def client(text: str, attempt: int) -> str:
    """Fails the first attempts of a call, as its number says; then cites the first document, no further than its end."""
    first = re.search(r"^=== documento (\d+) ===\n(.*?)(?=\n\n=== documento \d+ ===\n|\Z)", text, re.S)
    call = int(first[1]) // 3
    if attempt <= call % 5:
        if call % 2 == 0:
            raise ConnectionError("refused")
        return "no object"
    quote = first[2].strip()[:15].strip() or "vazio"
    answer = lambda value, document, part: {"valor": value, "citacao_documento": document, "citacao_trecho": part}
    return json.dumps({"campos": {"qualidade": answer(1, first[1], quote), "tom": answer("N/A", None, None)}})


CALLS = """WITH x AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id // 3 AS call_id, doc_id, text, doc_id % 7 = 0 OR coalesce(x.toxic, 0) = 1 AS s, doc_id % 13 <> 0 AND text IS NOT NULL AS c FROM documents LEFT JOIN x USING (doc_id)),
g AS (SELECT call_id, count(*) FILTER (NOT s) AS u, count(*) FILTER (NOT s AND c) AS t, arg_min(text, doc_id) FILTER (NOT s AND c) AS text FROM d GROUP BY 1),
o AS (SELECT *, CASE WHEN u = 0 THEN 'edital_escaneado_sem_ocr' WHEN t = 0 THEN 'entrada_sem_texto_util' WHEN call_id % 5 <= 2 THEN 'codificado' WHEN call_id % 2 = 0 THEN 'provedor' ELSE 'esquema' END AS outcome, CAST(CASE WHEN t = 0 THEN 0 ELSE least(call_id % 5 + 1, 3) END AS INT) AS attempts FROM g) """
query("l2_coding", CALLS + "SELECT call_id, outcome, attempts FROM o", base=False)(lambda spark, d: coding.code(_calls(spark, d), client, BOOK).outcomes)
query("l2_catalogue", CALLS + "SELECT call_id, field, CASE WHEN field = 'qualidade' AND NOT regexp_matches(text, '\\S') THEN 'citacao_invalidada' ELSE 'ok' END AS verification FROM o, (SELECT unnest(['qualidade', 'tom']) AS field) WHERE outcome = 'codificado'", base=False)(
    lambda spark, d: coding.code(_calls(spark, d), client, BOOK).fields.select("call_id", "field", "verification")
)
query("l2_verified_by_batch", ", c AS (SELECT doc_id % 3 AS batch_id, quality = 1 AS ok FROM labels) SELECT batch_id, count(*) AS n FROM c WHERE ok GROUP BY 1")(lambda spark, d: coding.catalogued(coded(spark, d)))
query("l2_inputs", CALLS + "SELECT call_id, string_agg('=== documento ' || doc_id || ' ===' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS input FROM d GROUP BY 1", base=False)(lambda spark, d: coding.sections(_calls(spark, d)).select("call_id", "input"))
OPENED = ", b AS (SELECT id, id % 3 AS model, CASE WHEN id % 4 <> 0 THEN id % 7 END AS seed, CASE WHEN id % 10 = 0 THEN 'aberto' ELSE 'concluido' END AS status FROM queue) "
_batches = lambda c: c.queue.select("id", (F.col("id") % 3).alias("model"), F.when(F.col("id") % 4 != 0, F.col("id") % 7).alias("seed"), F.when(F.col("id") % 10 == 0, "aberto").otherwise("concluido").alias("status"))
query("batch_reopened", OPENED + "SELECT id, model, seed, CASE WHEN id = (SELECT max(id) FROM b WHERE model = 1 AND seed = 5 AND status = 'concluido') AND NOT EXISTS (SELECT 1 FROM b WHERE model = 1 AND seed = 5 AND status = 'aberto') THEN 'aberto' ELSE status END AS status FROM b")(
    lambda spark, d: coding.open_batch(_batches(model.catalog(spark, d)), {"model": 1, "seed": 5}, ["model", "seed"])
)
query("batch_opened", OPENED + "SELECT id, model, seed, status FROM b UNION ALL SELECT max(id) + 1, 9, NULL, 'aberto' FROM b")(lambda spark, d: coding.open_batch(_batches(model.catalog(spark, d)), {"model": 9, "seed": None}, ["model", "seed"]))

# ---- discovery over pages that link to each other --------------------------------------------------------------------


def _web(spark: SparkSession, d: str) -> DataFrame:
    """The pages under five hosts, each with three more links: two to sections of its own host, one to a file."""
    k = F.col("page_id")
    at = lambda n: F.concat(F.lit("https://h"), (n % 5).cast("string"), F.lit(".org/p/"), n.cast("string"))
    link = lambda href, anchor: F.concat(F.lit('<a href="'), href, F.lit('">'), F.lit(anchor), F.lit("</a>"))
    section = lambda n: F.concat(F.lit("/p/"), n.cast("string"))
    more = F.concat(link(section(k + 5 * (k % 3 + 1)), "Inovação e Startup"), link(section(k + 5 * (k % 7 + 2)), "Editais"), link(F.concat(F.lit("/docs/"), (k % 50).cast("string"), F.lit(".pdf?utm_x=1")), "x"))
    return model.table(spark, d, "pages").select("page_id", at(k).alias("url"), F.concat("html", more).alias("html"))


def _explored(spark: SparkSession, d: str, **options) -> stages.Explored:
    web = _web(spark, d)
    return stages.explore(web.where("page_id < 10").select("url"), web.select("url", "html"), 3, **options)


WEB = """WITH RECURSIVE p AS (SELECT page_id AS id FROM pages),
e AS (SELECT id, id + 5 * (id % 3 + 1) AS t FROM p UNION SELECT id, id + 5 * (id % 7 + 2) FROM p),
r(id, depth) AS (SELECT id, 0 FROM p WHERE id < 10 UNION SELECT e.t, r.depth + 1 FROM r JOIN e ON e.id = r.id WHERE r.depth < 3),
v AS (SELECT id, min(depth) AS depth FROM r JOIN p USING (id) GROUP BY 1),
l AS (SELECT v.id, depth, 'https://h' || t % 5 || '.org/p/' || t AS url, 'secao' AS class FROM v JOIN e USING (id) UNION ALL SELECT id, depth, 'https://h' || id % 5 || '.org/docs/' || id % 50 || '.pdf', 'candidato/pdf' FROM v) """
query("discovery", WEB + "SELECT url, class, CAST(min(depth) AS INT) AS depth, min('https://h' || id % 5 || '.org/p/' || id) AS page FROM l GROUP BY 1, 2", base=False)(lambda spark, d: _explored(spark, d).found)
query("discovery_visits", WEB + "SELECT 'https://h' || id % 5 || '.org/p/' || id AS page FROM v", base=False)(lambda spark, d: _explored(spark, d).visited)
query("discovery_again", WEB + "SELECT url, class, CAST(0 AS INT) AS depth, url AS page FROM l WHERE false", base=False)(lambda spark, d: _explored(spark, d, visited=_explored(spark, d).visited).found)
query("origins", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) AS origin FROM pages", base=False)(lambda spark, d: model.table(spark, d, "pages").select("page_id", urls.origin(F.col("url")).alias("origin")))

# ---- the event log, exports, words ------------------------------------------------------------------------------------


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """Events whose details have names out of order, and a tenth that isn't JSON; written to the log and read again."""
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.concat(F.lit('{"z": '), F.col("event_id").cast("string"), F.lit(', "a": {"y": "'), F.col("event_type"), F.lit('", "b": [1, '), F.col("user_id").cast("string"), F.lit(']}, "k": '), F.get_json_object("props", "$.k"), F.lit("}")))
    path = shared_folder(spark)
    eventlog.append(model.table(spark, d, "events").select(*eventlog.event("coletar", "visita", raw, F.col("ts").cast("timestamp"))), path)
    return eventlog.read(spark, path)


LOGGED = """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, event_id % 10 = 0 AS bad, event_type, user_id, json_extract_string(props, 'k') AS k FROM events) """
query("event_log", LOGGED + """SELECT day, CASE WHEN bad THEN '{}' ELSE '{"a":{"b":[1,' || user_id || '],"y":"' || event_type || '"},"k":' || k || ',"z":' || event_id || '}' END AS detail FROM e""", base=False)(lambda spark, d: _logged(spark, d).select("day", eventlog.canonical(F.col("detail")).alias("detail")))
query("event_log_typed", LOGGED + "SELECT day, event_type AS kind, count(*) AS n, CAST(sum(CAST(k AS BIGINT)) AS BIGINT) AS k, CAST(sum(user_id) AS BIGINT) AS users FROM e WHERE NOT bad GROUP BY 1, 2", base=False)(
    lambda spark, d: _logged(spark, d).select("day", F.try_variant_get("detail", "$.a.y", "string").alias("kind"), F.try_variant_get("detail", "$.k", "bigint").alias("k"), F.try_variant_get("detail", "$.a.b[1]", "bigint").alias("u")).where("kind IS NOT NULL").groupBy("day", "kind").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.sum("u").alias("users"))
)
query("log_lists", """SELECT event_id, e.k AS etapa, e.v AS valor FROM (SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN [{'k': '1', 'v': 'x'}, {'k': '2', 'v': CAST(user_id AS VARCHAR)}, {'k': '3', 'v': NULL}, {'k': '4', 'v': '{"a":2,"b":true}'}] WHEN 1 THEN [{'k': 'k', 'v': json_extract_string(props, 'k')}] END) AS e FROM events)""", base=False)(
    lambda spark, d: eventlog.log_entries(model.table(spark, d, "events").withColumn("log", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["x", '), F.col("user_id").cast("string"), F.lit(', null, {"b": true, "a": 2}]'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("oops")), "event_id", "log")
)
ORDER = ("year", "institution", "call_id", "id")
query("listing_numbered", ", l AS (SELECT * FROM base WHERE NOT excluded) SELECT id, row_number() OVER (ORDER BY coalesce(year, 9999), institution, call_id, id) AS n FROM l")(
    lambda spark, d: joins.row_numbers(catalog.listing(model.catalog(spark, d)).select(F.coalesce("year", F.lit(9999)).alias("year"), "institution", "call_id", "id"), ORDER, "n").select("id", "n")
)


def _axis3_file(spark: SparkSession, d: str) -> DataFrame:
    """The third axis' detail, written in order and read again."""
    rows = model.table(spark, d, "documents").select("doc_id", rules.axis3(F.col("text"), **AXIS).alias("r")).select("doc_id", "r.code", "r.evidence")
    path = shared_folder(spark)
    files.write_listing(rows, path, ("code", "doc_id", "evidence"))
    return files.read_listing(spark, path, "code string, doc_id long, evidence string")


query("axis3_export", AXIS_SQL + "SELECT code, doc_id, nullif(evidence, '') AS evidence FROM x")(_axis3_file)
query("sampled", "SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 100", base=False)(lambda spark, d: mining.sample(model.table(spark, d, "documents"), 100).select("doc_id"))
query("previews", "SELECT doc_id, substr(text, 1, 80) AS preview FROM documents ORDER BY doc_id LIMIT 10", base=False)(lambda spark, d: model.table(spark, d, "documents").orderBy("doc_id").limit(10).select("doc_id", F.substring("text", 1, 80).alias("preview")))
TOP = ngram_sql(1, 1) + ", top AS (SELECT term, count(*) AS freq FROM terms GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 30)"
query("heavy_terms", TOP + " SELECT * FROM top")(lambda spark, d: mining.heavy_terms(model.corpus(spark, d), 30, stopwords=STOP))
query(
    "cooccurrence_matrix",
    TOP + """, k AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), ' ') AS w FROM corpus), j AS (SELECT doc_id, w[p] AS t, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM k)),
i AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM j JOIN top ON top.term = j.t),
c AS (SELECT a.t AS t1, b.t AS t2, count(*) AS n FROM i a JOIN i b ON a.doc_id = b.doc_id AND abs(b.i - a.i) BETWEEN 1 AND 10 AND a.t <> b.t GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a.term AS t1, b.term AS t2, coalesce(c.n, 0) AS n FROM top a CROSS JOIN top b LEFT JOIN c ON c.t1 = a.term AND c.t2 = b.term""",
)(lambda spark, d: mining.window_matrix(model.corpus(spark, d), 30, 10, 2, stopwords=STOP))
query("dimension_pivot", SIGNAL_SQL + "SELECT dimension, " + ", ".join(f'round(avg(CASE WHEN len(f) > 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FILTER (year = {y}), 1) AS "{y}"' for y in YEARS) + " FROM m GROUP BY 1")(
    lambda spark, d: mining.prevalence(mining.signals(model.corpus(spark, d), DIMENSIONS, by=["year"]), ["year"]).groupBy("dimension").pivot("year", YEARS).agg(F.first("pct"))
)
query("ocr_rescue", "WITH p AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 2 * l_quantity ELSE (2 * l_quantity + CAST(l_suppkey % 101 AS DOUBLE)) / 2 END AS c FROM lineitem) SELECT doc_id, count(*) FILTER (c >= 60) AS rescued, round(avg(c) FILTER (c >= 60), 1) AS confidence FROM p GROUP BY 1", base=False)(
    lambda spark, d: rules.ocr_rescue(model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.array(F.struct(F.lit("a").alias("word"), (2 * F.col("l_quantity")).alias("conf")), F.struct(F.lit("b").alias("word"), F.when(F.col("l_returnflag") == "R", -1.0).otherwise((F.col("l_suppkey") % 101).cast("double")).alias("conf"))).alias("words")))
)
# connectives and stopwords are planted into the texts, as the given corpus has none
PLANTED = " no que se refere palavra-chave Bem Como outra palavra; por meio de novas palavras the "
query("planted_connectives", ", planted AS (SELECT doc_id, institution, year, list_concat(w, CASE WHEN doc_id % 3 = 0 THEN ['palavra', 'chave', 'outra', 'palavra', 'novas', 'palavras'] ELSE [] END) AS w FROM toks)" + ngram_sql(1, 2).replace("FROM toks", "FROM planted") + "SELECT term, count(*) AS freq FROM terms GROUP BY 1 HAVING count(*) >= 2")(
    lambda spark, d: mining.term_frequency(model.corpus(spark, d).withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, PLANTED).otherwise(""))), (1, 2), 2, STOP)
)
