"""Golden scenarios of the catalogue, the rule engines, the stages and the miners."""

import json
import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folioscope import registry
from folioscope.operators import catalog as C
from folioscope.operators import coding, mining, rules, stages

DOCS = [  # id, institution, accepted year, queue decision
    ("a", 1, "integra", 2023, None), ("b", 1, "integra", 2024, None), ("gemeo", 1, "integra", 2023, None), ("outro", 1, "integra", None, 2025),
    ("c", 1, "integra", None, 2022), ("p", 1, "integra", None, "pendente"), ("e", 1, "integra", None, "excluir"), ("f", 2, "agencia_inovacao", 2024, None),
]


@pytest.fixture
def catalog(spark):
    docs = [(d, d, f"u/{d}", i, y, None, None, None, False, None, d, i) for i, (d, _, _, y, _) in enumerate(DOCS)]
    queue = [(10 + i, f"u/{d}", 1, "pendente" if q == "pendente" else "resolvida", q if isinstance(q, int) else None, q == "excluir") for i, (d, *_, q) in enumerate(DOCS) if q is not None]
    return C.Catalog(
        institutions=spark.createDataFrame([(1, "TST"), (2, "AGI")], "id long, code string"),
        portals=spark.createDataFrame([(1, 1, "integra"), (2, 2, "agencia_inovacao")], "id long, institution_id long, category string"),
        calls=spark.createDataFrame([(d, i) for d, i, *_ in DOCS], "id string, institution_id long"),
        documents=spark.createDataFrame(docs, "id string, call_id string, url string, captured_at int, accepted_year int, provisional_year int, text_path string, text_chars int, scanned boolean, ocr_at string, hash string, seq int"),
        candidates=spark.createDataFrame([(i, f"u/{d}", 1 if n == 1 else 2, "pdf", None) for i, (d, n, *_) in enumerate(DOCS)], "id long, url string, portal_id long, kind string, anchor string"),
        queue=spark.createDataFrame(queue, "id long, url string, portal_id long, status string, decided_year int, excluded boolean"),
        classifications=spark.createDataFrame([("u/a", "inovacao", "AUSENTE_SILENCIAMENTO")], "url string, kind string, axis3 string"),
    )


@pytest.mark.parametrize("options,listed,excluded", [({}, 7, 1), ({"institution": "tst"}, 6, 1), ({"institution": "AGI"}, 1, 0), ({"year": 2024, "category": "agencia_inovacao"}, 1, 0), ({"year": 2024}, 2, 1), ({"category": "integra"}, 6, 1), ({"year": 2025}, 1, 1), ({"year": 2019}, 0, 1), ({"institution": "XXX"}, 0, 0), ({"call": "GEM"}, 1, 0)])
def test_listing(catalog, options, listed, excluded):
    assert C.listing(catalog, **options).count() == listed and C.excluded_count(catalog, **options).first()[0] == excluded


def test_listing_order_and_sources(catalog):
    rows = C.listing(catalog).collect()
    assert [r.id for r in rows] == ["f", "c", "a", "gemeo", "b", "outro", "p"]
    assert {r.year_source: r.n for r in C.year_sources(C.listing(catalog)).collect()} == {"automatica": 4, "fila_humana": 2, "vazio": 1}


def test_newest_resolution_wins(spark, catalog):
    more = catalog.queue.unionByName(spark.createDataFrame([(99, "u/outro", 1, "resolvida", 2024, False), (100, "u/outro", 1, "pendente", None, False)], catalog.queue.schema))
    c = C.Catalog(**{**catalog.__dict__, "queue": more})
    assert C.listing(c).count() == 7 and C.listing(c, year=2025).count() == 0 and C.listing(c, year=2024).count() == 3
    assert {r.queue_id for r in C.effective_queue(more).where("url = 'u/outro'").collect()} == {99}


def test_dating(spark):
    cases = [({}, (None, None, "sem_data")), ({"url": [2022]}, (None, None, "baixa_confianca_sourl")), ({"url": [2023], "ancora": [2023]}, (2023, "url", None)), ({"ancora": [2022], "pdf_meta": [2022]}, (2022, "ancora", None)), ({"pdf_meta": [2024]}, (2024, "pdf_meta", None)), ({"url": [2021], "ancora": [2023], "pdf_meta": [2021]}, (None, None, "divergencia")), ({"url": [], "ancora": [2023], "pdf_meta": []}, (2023, "ancora", None)), ({"time_tag": [2024]}, (2024, "time_tag", None)), ({"pdf_meta": [2024], "time_tag": [2024]}, (2024, "pdf_meta", None))]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m map<string,array<int>>")
    assert [tuple(r.d) for r in df.select("i", rules.dating(F.col("m")).alias("d")).orderBy("i").collect()] == [w for _, w in cases]


def test_classify(spark):
    rows = spark.createDataFrame([(1, "a INOVACAO social", "x"), (2, "nada", "Edital de Inovação"), (3, "nada", "x"), (4, None, "Inovação"), (5, " ", None)], "id int, text string, anchor string")
    found = {r.id: r for r in rules.classify(rows, ["inovação", "inovação social"], {"d1": ["inovação"], "d2": ["inovação", "inovação social"]}).collect()}
    assert [(found[i].kind, found[i].method) for i in range(1, 6)] == [("inovacao", "texto"), ("inovacao", "ancora"), ("nao_inovacao", "texto"), ("inovacao", "ancora"), ("sem_texto", "sem_texto")]
    assert found[1].signals == ["inovação", "inovação social"] and found[1].dimensions == ["d1", "d2"] and found[1].anchor_evidence is None and found[2].anchor_evidence == "Edital de Inovação"


def test_axis3(spark):
    texts = ["há COTAS para tecnologia social e potencial de mercado", "só cotas", "tecnologia social", "potencial de mercado e viabilidade financeira", "potencial de mercado", "potencial de mercado, viabilidade financeira e inclusão", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.r for r in df.select("i", rules.axis3(F.col("t")).alias("r")).orderBy("i").collect()]
    s, i, a = "IMPACTO_SUBSTANTIVO", "IMPACTO_INSTRUMENTAL", "AUSENTE_SILENCIAMENTO"
    assert [x.code for x in got] == [s, a, a, i, a, a, a, a]
    assert "COTAS" in got[0].evidence and got[3].signals == ["potencial de mercado", "viabilidade financeira"] and got[1].evidence == ""


def test_consecutive_runs(spark):
    e = spark.createDataFrame([("h", i, s) for i, s in enumerate([403, 403, 200, 403, 403, 403, 404])], "host string, ts int, status int")
    hit = F.col("status") == 403
    assert [r.run for r in rules.consecutive(e, "host", ["ts"], hit).orderBy("ts").collect()] == [1, 2, 0, 1, 2, 3, 0]
    assert [tuple(r) for r in rules.suspended(e, "host", ["ts"], hit).collect()] == [("h", 3)]


def test_ocr_rescue(spark):
    pages = spark.createDataFrame([(1, 1, [("a", 80.0), ("b", -1.0)]), (1, 2, [("c", 50.0)]), (1, 3, [("d", 60.0), ("e", 70.0)]), (2, 1, [])], "doc_id int, page int, words array<struct<word:string,conf:double>>")
    assert {r.doc_id: (r.rescued, r.confidence) for r in rules.ocr_rescue(pages).collect()} == {1: (2, 72.5), 2: (0, None)}


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "u1", None), (1, "u2", "x")], "portal int, url string, anchor string")
    new = spark.createDataFrame([(1, "u1", "n"), (1, "u2", "n"), (2, "u1", "m")], old.schema)
    keys = ["portal", "url"]
    once = stages.fill_nulls(old, new, keys, ["anchor"], ["anchor"])
    assert sorted(map(tuple, once.collect())) == [(1, "u1", "n", False), (1, "u2", "x", False), (2, "u1", "m", True)]
    again = stages.fill_nulls(once.drop("inserted"), new, keys, ["anchor"], ["anchor"])
    assert sorted(map(tuple, again.drop("inserted").collect())) == sorted(map(tuple, once.drop("inserted").collect())) and again.where("inserted").count() == 0
    for f in (stages.insert_or_ignore, stages.insert_or_replace):
        a = f(old, new, keys, ["anchor"])
        assert sorted(map(str, f(a, new, keys, ["anchor"]).collect())) == sorted(map(str, a.collect())) and a.count() == 3


def test_queue_rules(spark, catalog):
    q = stages.enqueue(catalog.queue, spark.createDataFrame([(50, "u/p"), (51, "u/novo"), (52, "u/novo")], "id long, url string"))
    assert q.count() == catalog.queue.count() + 1 and q.where("url = 'u/novo'").first().status == "pendente"
    pending = catalog.queue.where("status = 'pendente'").first().id
    decisions = spark.createDataFrame([(pending, 2024, None, "j", "a"), (10_000, 2024, None, "j", "a"), (13, None, True, "", "a")], "id long, year int, exclude boolean, justification string, author string")
    after, refused = stages.decide(catalog.queue, decisions)
    assert after.where(F.col("id") == pending).first().decided_year == 2024
    assert sorted(r.problems for r in refused.collect()) == [["inexistente"], ["nao_pendente", "sem_justificativa"]]


def test_captures(spark):
    rows = [(1, "u1", "h1", 1), (1, "u1", "h1", 2), (1, "u1", "h2", 3), (1, "u2", "h1", 4), (2, "u3", "h1", 5), (1, "u4", "h9", 6)]
    got = stages.captures(spark.createDataFrame(rows, "portal_id int, url string, hash string, seq int")).orderBy("seq").collect()
    assert [(r.action, r.refers_to) for r in got] == [("novo", None), ("restaurado", None), ("nova_versao", None), ("alias", "u1"), ("novo", None), ("novo", None)]


def test_sync_and_transition(spark):
    a, b = (spark.createDataFrame(x, "code string, v int") for x in ([("A", 1), ("B", 2), ("C", 3)], [("a", 1), ("b", 9), ("D", 4)]))
    assert {(r.code.upper(), r.v, r.action) for r in stages.sync(a, b, "code").collect()} == {("A", 1, "inalterado"), ("B", 9, "atualizado"), ("C", 3, "ausente"), ("D", 4, "criado")}
    rows = stages.transition(spark.createDataFrame([(1, "pendente"), (2, "concluida")], "id int, status string"), "iniciar").orderBy("id").collect()
    assert [(r.status, r.moved) for r in rows] == [("rodando", True), ("concluida", False)]


def test_host_scope_and_discovery(spark):
    portals = spark.createDataFrame([(1, ["http://www.a.org/"]), (2, ["http://b.org"]), (3, ["https://b.org/x"])], "portal_id int, urls array<string>")
    got = {r.url: (r.status, r.portal_id) for r in stages.host_scope(spark.createDataFrame([("http://a.org/y",), ("http://b.org",), ("http://c.org",)], "url string"), portals).collect()}
    assert got == {"http://a.org/y": ("ok", 1), "http://b.org": ("ambiguo", None), "http://c.org": ("fora_do_escopo", None)}
    pages = spark.createDataFrame([("http://a.org/", '<a href="/editais/1">x</a><a href="/inov">Inovação</a><a href="http://z.org/e.pdf">p</a>'), ("http://a.org/inov", '<a href="e.pdf">pdf</a><a href="/">Inovação</a>')], "url string, html string")
    found = {(r.url, r["class"], r.depth) for r in stages.discover(pages.limit(1).select("url"), pages, 2).collect()}
    assert found == {("http://a.org/editais/1", "candidato/pagina_edital", 0), ("http://a.org/inov", "secao", 0), ("http://a.org/e.pdf", "candidato/pdf", 1), ("http://a.org/", "secao", 1)}


def brute_pairs(texts, vocabulary, window):
    n = Counter()
    for t in texts:
        w = [x for x in t.lower().split() if x in vocabulary]
        for i, a in enumerate(w):
            n.update(tuple(sorted((a, b))) for b in w[i + 1 : i + 1 + window] if a != b)
    return n


def test_mining_matches_brute_force(spark):
    r = random.Random(0)
    texts = [" ".join(r.choice("ana anana b, banana c ça 12 x1 o\nque".split(" ")) for _ in range(40)) for _ in range(30)]
    corpus = spark.createDataFrame([(i, t, "g" + str(i % 2)) for i, t in enumerate(texts)], "doc_id long, text string, g string")
    got = {(x.t1, x.t2): x.n for x in mining.cooccurrence(corpus, ["ana", "b,", "c", "banana"], 3, 1).collect()}
    assert got == dict(brute_pairs(texts, {"ana", "b,", "c", "banana"}, 3))
    hits = []
    for i, t in enumerate(texts):
        t, p = " ".join(t.lower().split()), -1
        while (p := t.find("ana", p + 1)) >= 0:
            hits.append((i, p, t[max(0, p - 5) : p] + "**ana**" + t[p + 3 : p + 8]))
    assert [tuple(x) for x in mining.concordance(corpus, " ANA ", 5, None).collect()] == hits and mining.concordance(corpus, "ana", 5, 7).count() == 7
    freq = Counter()
    for t in texts:
        w = [x for x in re.findall(r"\b[^\W\d_]\w+\b", t.lower()) if x not in ("que",)]
        freq.update(x for x in w + [" ".join(p) for p in zip(w, w[1:])] if not re.search(r"\d", x))
    assert {x.term: x.freq for x in mining.term_frequency(corpus, (1, 2), 1, ["que"]).collect()} == dict(freq)
    heat = mining.term_heatmap(corpus, "g", 3)
    assert heat.count() == 6 and mining.top_terms_by(corpus, "g", 2).count() == 4


def test_signals(spark):
    corpus = spark.createDataFrame([(1, "A Transferência  de TECNOLOGIA"), (2, "de tecnologia só"), (3, "nada")], "doc_id int, text string")
    dims = {"d": ["transferência de tecnologia", "patente"]}
    assert [r.n for r in mining.signals(corpus, dims).orderBy("doc_id").collect()] == [1, 1, 0]
    assert [r.n for r in mining.signals(corpus, dims, bigrams=False).orderBy("doc_id").collect()] == [1, 0, 0]
    assert mining.prevalence(mining.signals(corpus, dims)).first().pct == 66.7


def test_tfidf_rows_have_unit_length(spark):
    corpus = spark.createDataFrame([(i, f"casa azul {'verde' if i % 2 else 'mar'} termo{chr(97 + i)}") for i in range(10)], "doc_id int, text string")
    w = mining.tfidf(corpus, max_df=1.0)
    assert all(abs(r[1] - 1) < 1e-9 for r in w.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight"))).collect())
    assert {r.term for r in w.select("term").distinct().collect()} == {"casa", "azul", "verde", "mar"}
    assert mining.project_2d(w).count() == 10


BOOK = coding.Codebook([coding.Field("q", ordinal=(0, 1, 2)), coding.Field("n", labels=("sim", "não"), allows_na=True)], {"g": False, "h": True})


@pytest.mark.parametrize(
    "change,wanted",
    [({}, []), ({"q": None}, ["falta q"]), ({"x": {}}, ["sobra x"]), ({"q.valor": 7}, ["q: valor invalido"]), ({"q.valor": True}, ["q: valor invalido"]), ({"q.valor": "1"}, ["q: valor invalido"]), ({"q.citacao_documento": "z"}, ["q: documento desconhecido"]), ({"q.citacao_trecho": " "}, ["q: sem trecho"]), ({"q.citacao_trecho": None}, ["q: sem trecho"]), ({"n.valor": "N/A"}, ["n: citacao em N/A"]), ({"n.valor": "talvez"}, ["n: valor invalido"]), ({"q.valor": "N/A"}, ["q: valor invalido"]), ({"q.extra": 1}, ["q: chave extra"]), ("raiz", ["raiz invalida"]), ("nada", ["raiz invalida"])],
)
def test_contract(spark, change, wanted):
    answer = {"q": {"valor": 1, "citacao_documento": "d1", "citacao_trecho": "t"}, "n": {"valor": "sim", "citacao_documento": "d1", "citacao_trecho": "t"}}
    if isinstance(change, dict):
        for k, v in change.items():
            name, _, part = k.partition(".")
            if part:
                answer[name][part] = v
            elif v is None:
                del answer[name]
            else:
                answer[name] = v
    raw = "sem json" if change == "nada" else "ok: " + json.dumps({"outro": 1} if change == "raiz" else {"campos": answer}, ensure_ascii=False) + " fim"
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(coding.problems(F.col("raw"), BOOK, F.array(F.lit("d1"))).alias("p")).first().p == wanted


def test_coding_from_input_to_catalogue(spark):
    docs = spark.createDataFrame([("c1", 2, "d2", "segundo"), ("c1", 1, "d1", "primeiro\ntrecho aqui")], "call_id string, captured_at int, doc_id string, text string")
    ready = coding.inputs(docs)
    assert ready.first().documents == ["d1", "d2"]
    reply = json.dumps({"campos": {"q": {"valor": 1, "citacao_documento": "d1", "citacao_trecho": "Trecho  AQUI"}, "n": {"valor": "N/A", "citacao_documento": None, "citacao_trecho": None}}})
    coded = coding.code_calls(ready, lambda text: reply)
    assert coded.select(coding.problems(F.col("raw"), BOOK, F.col("documents")).alias("p")).first().p == []
    checked = {r.field: r for r in coding.verify(coding.answers(coded, "raw", BOOK, ["call_id"]), docs).collect()}
    assert checked["q"].page == 2 and checked["q"].verification == "ok" and checked["n"].verification == "ok"
    assert BOOK.pending_gates() == ["g"]


def test_batches(spark):
    rows = spark.createDataFrame([(1, "m", None, "concluido"), (2, "m", None, "aberto"), (3, "m", 5, "aberto"), (4, "m", None, "concluido")], "id int, model string, seed int, status string")
    assert coding.find_batch(rows, {"model": "m", "seed": None}, ["model", "seed"]).first().id == 2
    assert coding.find_batch(rows, {"model": "z"}, ["model", "seed"]).count() == 0
    assert coding.close_batch(rows, 2).where("status = 'aberto'").count() == 1


def test_citation_check_looks_at_every_document(spark, tmp_path):
    quotes = {1: "Um  trecho", 2: "straße", 3: "nada", 4: "", 5: None}
    texts = {i: f"linha {i}\n\num TRECHO {i}" if i % 3 == 0 else f"STRASSE\n{i}" for i in range(1, 8)} | {50: None, 51: ""}
    spark.createDataFrame(list(quotes.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(1, d): 3 for d in (3, 6)} | {(2, d): 1 for d in (1, 2, 4, 5, 7)}
    out = registry.queries()["citation_check"](spark, str(tmp_path)).collect()
    assert len(out) == len(want) and {(r.quote_id, r.doc_id): r.page for r in out} == want


def test_batch_lookup_takes_the_whole_queue(spark):
    queue = spark.range(2000).select("id")
    c = SimpleNamespace(queue=queue)
    want: dict = {}
    for i in range(2000):
        key = (i % 7 if i % 4 else None, i % 3)
        want[key] = max(want.get(key, (False, -1)), (i % 10 == 0, i))
    signatures = {(i % 7 if i % 5 else None, i % 3) for i in range(2000)}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registry.model, "catalog", lambda spark, d: c)
        out = registry.queries()["batch_lookup_nullsafe"](spark, "").collect()
    assert {(r.seed, r.model): r.batch_id for r in out} == {k: v[1] for k, v in want.items() if k in signatures} and len(out) == len(signatures)


def test_projection_uses_as_many_terms_as_tfidf(spark, tmp_path):
    word = lambda k: "w" + "".join(chr(97 + int(x)) for x in str(k))
    texts = [" ".join(word(k) for k in range(210)) + f" {word(9000 + i)}" for i in range(4)] + [" ".join(word(k) for k in range(300, 310))] * 2
    spark.createDataFrame([(i, t, "pt", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in registry.queries()["tfidf_projection"](spark, str(tmp_path)).collect()} == set(range(6))
