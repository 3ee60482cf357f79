"""Stages that read and write tables of their own: a second run changes nothing, and plain versions agree."""

import csv
import glob
import io
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope import registry
from folioscope.operators import classifying, coding, dating, eventlog, joins, mining, rules, stages
from folioscope.sources import files
from folioscope.sources.buckets import Buckets

DOCS = "id long, url string, portal_id long, anchor string, created string, modified string, title string, readable boolean, html string, method string"


def test_dating_is_a_stage(spark):
    page = '<p class="post-date">5/2023</p><time datetime="2021-01-01">x</time>'
    rows = [
        (1, "http://h/2023/a", 1, "Edital 2023", None, None, None, True, None, None), (2, "http://h/2023/b", 1, " ", None, None, None, True, None, None), (3, "http://h/c", 1, None, "D:20240101", "2024", "Ano 2024", True, None, None),
        (4, "http://h/d", 2, "2020", "D:2021", None, None, True, None, None), (5, "http://h/e", 2, None, None, None, None, False, page, None), (6, "http://h/f", 2, None, None, None, None, True, "<time datetime='2022-05'>", None),
        (7, "http://h/g", 2, "2019", None, None, None, True, None, "url"), (8, "http://h/q", 2, "2019", None, None, None, True, None, None), (9, "http://h/2031/z", 2, "1999 e 2030", "D:2012", None, None, True, None, None),
        (10, "http://h/2023/b", 1, "2023", None, None, None, True, None, None), (11, "http://h/2023/s", 1, "2023", None, None, None, True, page, None),
    ]
    docs, queue = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(70, "http://h/q", 2, "resolvida")], "id long, url string, portal_id long, status string")
    first = dating.date_documents(docs, queue)
    found = {r.id: (r.outcome, r.year, r.method, r.reason) for r in first.outcomes.collect()}
    assert found == {
        1: ("aceito", 2023, "url", None), 2: ("fila", None, None, "baixa_confianca_sourl"), 3: ("aceito", 2024, "pdf_meta", None), 4: ("fila", None, None, "divergencia"), 5: ("erro", None, None, None), 6: ("aceito", 2022, "time_tag", None),
        7: ("pulado", None, None, None), 8: ("pulado", None, None, None), 9: ("fila", None, None, "sem_data"), 10: ("pulado", None, None, None), 11: ("fila", None, None, "divergencia"),
    }
    assert first.counters == {"aceito": 3, "fila": 4, "erro": 1, "pulado": 3}
    assert {r.id: r.outside for r in first.outcomes.collect()}[9] == [2012, 2030, 2031]
    assert sorted((r.id, r.url, r.status) for r in first.queue.collect()) == [(70, "http://h/q", "resolvida"), (71, "http://h/2023/b", "pendente"), (72, "http://h/d", "pendente"), (73, "http://h/2031/z", "pendente"), (74, "http://h/2023/s", "pendente")]
    assert {(r.id, r.source) for r in first.evidence.collect() if r.id == 3} == {(3, "url"), (3, "pdf_meta")}
    second = dating.date_documents(first.documents, first.queue)
    assert second.counters == {"aceito": 0, "fila": 0, "erro": 1, "pulado": 10} and second.queue.count() == 5
    agreed = {r.id: r.outcome for r in dating.judged(docs, queue, skip_agreed=True).collect()}
    assert agreed[11] == "aceito" and agreed[6] == "aceito"
    assert dating.date_documents(docs.limit(0), queue).counters == {"aceito": 0, "fila": 0, "erro": 0, "pulado": 0}


def test_buckets_rewrite_only_what_changes(spark, tmp_path):
    table = Buckets(spark, f"file://{tmp_path}/t", "k string, v int", ["k"], 8)
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert table.read().count() == 0 and table.add(batch(("a", 2), ("a", 1), ("b", 5), ("c", 7)), ["v"]) <= 3
    before = {f: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/t/bucket=*/part-*")}
    assert table.add(batch(("a", 9), ("b", 0)), ["v"]) == 0 and {f: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/t/bucket=*/part-*")} == before
    assert table.add(batch(("a", 9), ("b", 0), ("d", 1)), ["v"], F.col("v") == 5) in (1, 2)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 0), ("c", 7), ("d", 1)]
    assert sum(f in before for f in glob.glob(f"{tmp_path}/t/bucket=*/part-*")) >= 1 and table.add(batch(), ["v"]) == 0


def test_classification_stages(spark, tmp_path):
    rows = [(1, "a", 1, "tem inovação", "x", False), (2, "b", 1, None, "x", False), (3, "c", 1, "nada", "x", True), (4, "d", 2, "nada", "x", False), (5, "e", 2, None, "Edital de Inovação", None), (6, "b", 1, "inovação tardia", "x", False)]
    docs = spark.createDataFrame(rows, "id long, url string, portal_id long, text string, anchor string, excluded boolean")
    table = Buckets(spark, f"file://{tmp_path}/l1", classifying.LEVEL1, ["url"], 4)
    run = lambda d: classifying.level1(d, table, ["inovação"], {"d": ["inovação"]})
    read = lambda: {r.url: (r.kind, r.method) for r in table.read().collect()}
    assert run(classifying.aimed(docs.where("id < 6"), portal=1)) and read() == {"a": ("inovacao", "texto"), "b": ("sem_texto", "sem_texto")}
    assert run(classifying.aimed(docs.where("id < 6"), portal=1)) == 0
    assert run(classifying.aimed(docs, every=True)) and read() == {"a": ("inovacao", "texto"), "b": ("inovacao", "texto"), "d": ("nao_inovacao", "texto"), "e": ("inovacao", "ancora")}
    assert run(classifying.aimed(docs, every=True)) == 0 and run(classifying.aimed(docs, sweep=docs.select("url"))) == 0 and run(classifying.aimed(docs, url="c")) == 0
    assert {(r.portal_id, r.result): r.n for r in classifying.totals(docs, table.read(), "kind").collect()} == {(1, "inovacao"): 3, (1, "excluido"): 1, (2, "nao_inovacao"): 1, (2, "inovacao"): 1}
    with pytest.raises(ValueError):
        classifying.aimed(docs, portal=1, url="a")
    third = Buckets(spark, f"file://{tmp_path}/a3", classifying.AXIS3, ["url"], 4)
    words = {"triggers": ["tem"], "targets": ["inovação"], "required": ["nada"], "vetoed": ["tem"]}
    assert classifying.axis3(classifying.aimed(docs, every=True), third, **words) and classifying.axis3(classifying.aimed(docs, every=True), third, **words) == 0
    assert {r.url: (r.code, r.evidence) for r in third.read().collect()} == {"a": ("IMPACTO_SUBSTANTIVO", "tem inovação"), "b": ("AUSENTE_SILENCIAMENTO", ""), "d": ("IMPACTO_INSTRUMENTAL", "nada")}


def test_evidence_is_a_window_around_the_first_match(spark):
    text = "x" * 300 + " cota " + "y" * 50 + "  \n tecnologia social " + "z" * 300
    got = spark.createDataFrame([(text,), ("cota tecnologia social",)], "t string").select(rules.axis3(F.col("t"))["evidence"].alias("e")).collect()
    assert got[0].e == " ".join(text[301 - 120 : 301 + 120].split()) and got[1].e == "cota tecnologia social"


def test_exploring_goes_on_where_it_ended(spark):
    link = lambda t, a="Editais": f'<a href="/{t}">{a}</a>'
    pages = [("http://h/0", link(1) + link(2) + link("f.pdf", "x")), ("http://h/1", link(3) + link(0)), ("http://h/2", link(3)), ("http://h/3", link(4)), ("http://h/4", link(5)), ("http://h/5", "")]
    web, seeds = spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame([("http://h/0",), (None,), ("http://h/gone",)], "url string")
    depths = lambda e: {r.url[9:]: r.depth for r in e.found.collect()}
    first = stages.explore(seeds, web, 2)
    assert depths(first) == {"1": 0, "2": 0, "f.pdf": 0, "3": 1, "0": 1, "4": 2} and {r.page[9:] for r in first.visited.collect()} == {"0", "1", "2", "3"}
    again = stages.explore(seeds, web, 2, visited=first.visited)
    assert again.found.count() == 0 and again.visited.count() == 4
    more = stages.explore(spark.createDataFrame([("http://h/4",)], "url string"), web, 2, visited=first.visited)
    assert depths(more) == {"5": 0} and more.visited.count() == 6
    assert {r.page[9:] for r in stages.explore(seeds, web, 3, page_cap=3).visited.collect()} == {"0", "1"}  # the page that is gone counts too


def test_heavy_terms_are_exact(spark):
    r = random.Random(2)
    word = lambda: "w" + chr(97 + int(26 * r.random() ** 2)) + chr(97 + int(26 * r.random() ** 3))
    texts = [" ".join(word() for _ in range(200)) for _ in range(30)] + ["", None]
    counts = Counter(w for t in texts for w in (t or "").split())
    corpus = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for capacity in (2, 20, 10_000):
        for n in (1, 5, 40):
            want = sorted(((c, t) for t, c in counts.items() if c >= 2), key=lambda x: (-x[0], x[1]))[:n]
            assert [(x.freq, x.term) for x in mining.heavy_terms(corpus, n, capacity=capacity).orderBy(F.desc("freq"), "term").collect()] == want
    assert mining.heavy_terms(corpus.limit(0), 5).count() == 0 and mining.window_matrix(corpus.limit(0)).count() == 0
    grid = {(x.t1, x.t2): x.n for x in mining.window_matrix(spark.createDataFrame([("aa bb aa cc",), ("bb aa",), ("cc dd",)], "text string"), 3, 1, 1).collect()}
    assert len(grid) == 9 and grid["aa", "bb"] == grid["bb", "aa"] == 3 and grid["aa", "aa"] == 0 and grid["aa", "cc"] == 1


def test_listing_is_one_file_in_parts(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, r.choice(['a"b', "c,d", None, "e\nf", "", "é"]), r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t string, g int").repartition(3)
    joined = lambda p: "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{tmp_path}/{p}/part-*")))
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_listing(df, str(tmp_path / "l"), ["id", "t"], ["g", "id"])
        files.write_listing(df.limit(0), str(tmp_path / "e"), ["id", "t"])
        numbered = joins.row_numbers(df, ["g", "id"], "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    in_order = sorted(rows, key=lambda x: (x[2], x[0]))
    assert len(glob.glob(f"{tmp_path}/l/part-*")) > 1 and joined("e") == "id,t\n"
    assert list(csv.reader(io.StringIO(joined("l"), newline=""))) == [["id", "t"], *[[str(i), t or ""] for i, t, _ in in_order]]
    assert {x.id: x.n for x in numbered} == {x[0]: n for n, x in enumerate(in_order, 1)}


def test_event_log(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"b": [1, {"z": 1, "a": null}], "a": "x"}'), (2, "[1, \"t\", null]"), (3, "oops"), (4, None), (5, "7")], "i int, j string")
    assert [x.c for x in raw.orderBy("i").select(eventlog.canonical(eventlog.parsed(F.col("j"))).alias("c")).collect()] == ['{"a":"x","b":[1,{"a":null,"z":1}]}', '[1,"t",null]', "{}", "{}", "7"]
    assert sorted(map(tuple, eventlog.log_entries(raw, "i", "j").collect()), key=str) == sorted([(1, "a", "x"), (1, "b", '[1,{"a":null,"z":1}]'), (2, "1", "1"), (2, "2", "t"), (2, "3", None)], key=str)
    path = f"file://{tmp_path}/log"
    for day in ("2024-01-01 10:00:00", "2024-01-02 11:00:00", "2024-01-02 12:00:00"):
        eventlog.append(raw.where("i < 3").select(*eventlog.event("coletar", "visita", F.col("j"), F.lit(day).cast("timestamp"))), path)
    assert eventlog.read(spark, path).groupBy("day").count().count() == 2 and [str(x.ts) for x in eventlog.latest(spark, path, 2).collect()] == ["2024-01-02 12:00:00"] * 2


BOOK = coding.Codebook([coding.Field("q", ordinal=(0, 1)), coding.Field("n", labels=("sim",), allows_na=True)])


def answering(text, attempt):
    if "falha" in text:
        raise OSError
    if "nunca" in text or ("depois" in text and attempt < 3):
        return "sem json"
    first = text.split(" ", 2)[2].split(" ", 1)[0]
    return '{"campos": {"q": {"valor": 1, "citacao_documento": "%s", "citacao_trecho": "%s"}, "n": {"valor": "N/A", "citacao_documento": null, "citacao_trecho": null}}}' % (first, "inventado" if "mente" in text else "texto")


def test_coding_asks_again(spark):
    rows = [(1, "a", 1, "um texto", False, True), (1, "b", 2, "outro", True, True), (2, "c", 1, "depois texto", None, True), (3, "d", 1, "nunca", False, True), (4, "e", 1, "falha", False, True), (5, "f", 1, "x", True, True), (6, "g", 1, "x", False, False), (7, "h", 1, "mente", False, True), (8, "i", 1, None, False, True)]
    docs = spark.createDataFrame(rows, "call_id long, doc_id string, captured_at int, text string, scanned boolean, current boolean")
    coded = coding.code(docs, answering, BOOK, 3)
    assert {r.call_id: (r.outcome, r.attempts) for r in coded.outcomes.collect()} == {1: ("codificado", 1), 2: ("codificado", 3), 3: ("esquema", 3), 4: ("provedor", 3), 5: ("edital_escaneado_sem_ocr", 0), 6: ("entrada_sem_texto_util", 0), 7: ("codificado", 1), 8: ("entrada_sem_texto_util", 0)}
    assert sorted((r.call_id, r.field, r.verification) for r in coded.fields.collect()) == [(1, "n", "ok"), (1, "q", "ok"), (2, "n", "ok"), (2, "q", "ok"), (7, "n", "ok"), (7, "q", "citacao_invalidada")]
    assert coding.code(docs.limit(0), answering, BOOK).outcomes.count() == 0
    cut = spark.createDataFrame([(1, "a", 1, "12345"), (1, "b", 2, "67890"), (1, "c", 3, "x")], "call_id long, doc_id string, captured_at int, text string")
    assert coding.sections(cut, 8).first().input == "=== documento a ===\n12345\n\n=== documento b ===\n678"


def test_catalogue_cites_the_first_document_alone(spark, tmp_path):
    """Texts shorter than a quote, ones that begin with white space, and ones without a word."""
    texts = {0: "x", 1: "Curto.", 2: "outro", 3: " " * 20 + "fim", 4: "z", 6: "x", 7: "", 8: "z", 16: "ab", 31: "só um", 37: "\n\t ", 38: "z"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.queries()["l2_catalogue"](spark, str(tmp_path)).collect()
    ok, bad = "ok", "citacao_invalidada"
    assert {(r.call_id, r.verification) for r in found if r.field == "qualidade"} == {(0, ok), (1, ok), (2, ok), (5, ok), (10, ok), (12, bad)}


def _pages_numbered_like_years(spark, folder):
    ids = [7, 9, *range(2015, 2031), 12019, 20190]
    spark.createDataFrame([(i, "http://x/", "<p>x</p>") for i in ids], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con


def test_dating_stage_takes_no_page_number_for_a_year(spark, tmp_path):
    con = _pages_numbered_like_years(spark, tmp_path)
    found = sorted(map(tuple, registry.queries()["dating_stage"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(registry.oracle_sql()["dating_stage"]).fetchall())
    assert (2019, "fila", None, None, "sem_data") in found and (2022, "aceito", 2020, "url", None) in found


def test_dating_queue_takes_no_page_number_for_a_year(spark, tmp_path):
    con = _pages_numbered_like_years(spark, tmp_path)
    found = sorted(map(tuple, registry.queries()["dating_queue"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(registry.oracle_sql()["dating_queue"]).fetchall())
    assert (102026, "pendente", "sem_data") in found
