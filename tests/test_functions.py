"""Golden cases of the text, URL and year functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions import urls, years
from folioscope.functions.dictionaries import CONNECTIVES
from folioscope.operators import rules


def values(spark, cases, expression, kinds="string"):
    names = [f"c{i}" for i in range(len(kinds.split(",")))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split(","), strict=True))
    rows = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r.v for r in df.select("i", expression(*[F.col(n) for n in names]).alias("v")).orderBy("i").collect()]


def test_folds(spark):
    cases = ["Inovação  SOCIAL", "Straße ﬁx Ⅳ ½ ＡＢ ĳ", "É́", None]
    assert values(spark, cases, X.fold_collapsed)[:2] == ["inovacao social", X.python_fold(cases[1])]
    assert values(spark, ["Straße  É"], X.fold_light) == ["straße e"]
    assert values(spark, ["Straße  É"], X.fold_citation) == ["strasse é"]
    assert values(spark, cases, X.fold_collapsed)[2:] == ["e", None]
    for t in ("Ação Ñandú ÀÈÌÒÙ äöü çÇ ŠŽ", "Ἀθήνα ς", "ſtraße"):
        assert values(spark, [t], X.fold_collapsed) == [X.python_fold(t)]


@pytest.mark.parametrize("text,want", [("Mapas  VISTO QUE   planos", "mapas planos"), ("\t ", ""), (None, ""), ("dado  que sim", "dado que sim"), ("consoanteza consoante q", "consoanteza q"), ("uma vez que mediante amanhã", "amanhã")])
def test_clean(spark, text, want):
    assert values(spark, [text], lambda c: X.clean(c, CONNECTIVES)) == [want]


def test_tokens_and_ngrams(spark):
    assert values(spark, ["a é ab 1abc ação_1 2023 x9"], X.tokens) == [["ab", "ação_1", "x9"]]
    got = values(spark, ["um dois tres quatro"], lambda c: X.ngrams(X.without_words(X.tokens(c), ["dois"]), 1, 2))
    assert got == [["um", "tres", "quatro", "um tres", "tres quatro"]]


def test_keywords(spark):
    cases = ["Lista de EDITAIS", "aceleracao", "uma   startup nova", "o Nit daqui", "nitro", "negociantes", "notas de aula", None]
    assert values(spark, cases, X.has_keyword) == [True] * 4 + [False] * 4


def test_citation_page(spark):
    text = "Primeira página aqui\nSegunda   PÁGINA com texto\nTerceira"
    cases = [("segunda página COM", text), ("primeira", text), ("terceira", text), ("ausente", text), ("  ", text), ("aqui segunda", text), ("x", None), (None, text)]
    assert values(spark, cases, X.citation_page, "string,string") == [2, 1, 3, None, None, 1, None, None]


def test_occurrences_overlap(spark):
    assert values(spark, ["aaaa b aa", "x", "aa"], lambda c: X.occurrences(c, "aa")) == [[0, 1, 2, 7], [], [0]]


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTPS://Docs.Example.ORG/Lists/New/#top", "https://docs.example.org/Lists/New/"),
        ("https://Shop.Example.net/q?utm_term=w&UTM_id=3&p=7", "https://shop.example.net/q?p=7"),
        ("http://EXAMPLE.com", "http://example.com"),
        ("https://a.org/k?z=9&y=8&utm_content=c", "https://a.org/k?z=9&y=8"),
        ("http://a.org:80/x", "http://a.org/x"),
        ("https://a.org:443/x", "https://a.org/x"),
        ("http://a.org:8080/x", "http://a.org:8080/x"),
        ("https://a.org/b?t=caf%C3%A9%20au&x=%2B", "https://a.org/b?t=caf%C3%A9+au&x=%2B"),
        ("https://u:p@a.org/x?v", "https://a.org/x?v="),
        ("ftp://a.org/x", None),
        ("//no.scheme", None),
        ("words", None),
    ],
)
def test_canonical_url(spark, url, want):
    assert values(spark, [url], urls.canonical) == [want]


def test_slugs(spark):
    cases = ["http://h/Lista Nº 7_b!.PDF", "http://h/one-two.pdf", "http://h/q/", "http://h/P%C3%A3o_Doce.pdf"]
    assert values(spark, cases, urls.slug) == ["lista-no-7-b", "one-two", "documento", "pao-doce"]


def test_link_classes(spark):
    h = "https://h.org"
    cases = [("x", f"{h}/a.pdf"), ("x", f"{h}/a.PDF"), ("x", f"{h}/chamada-2024.html"), ("x", f"{h}/chamadas/abertas.html"), ("x", f"{h}/editais/"), ("x", f"{h}/contrachamada.html"), ("Inovação", f"{h}/inovacao"), ("Pesquisa", f"{h}/pesquisa"), ("", f"{h}/y")]
    want = ["candidato/pdf"] * 2 + ["candidato/pagina_edital"] * 3 + [None, "secao", None, None]
    assert values(spark, cases, urls.link_class, "string,string") == want


def test_hosts_and_links(spark):
    assert values(spark, ["http://WWW.example.org:80/x", "http://www2.example.org"], urls.scope_host) == ["example.org", "www2.example.org"]
    assert values(spark, ["mailto:a", "#x", "JavaScript:1", "/a", None], urls.followable) == [False, False, False, True, False]
    dots = [("http://h/a/b/c", "../x.pdf"), ("http://h/a/b/c", "../../../y?q=../z"), ("http://h/a/b", "./"), ("http://h/a/b/", ".."), ("http://h", "/p/./q/..")]
    assert values(spark, dots, urls.resolve, "string,string") == ["http://h/a/x.pdf", "http://h/y?q=../z", "http://h/a/", "http://h/a/", "http://h/p/"]
    assert values(spark, ["http://h/a.7z", "http://h/a.TAR", "http://h/a.gz?x", "http://h/a.jpg", "http://h/zip"], urls.is_file) == [True, True, True, False, False]
    other = values(spark, ["<a href='p?a=1&amp;b=2'>u</a><A class=k HREF=bare>v</A>"], urls.links)[0]
    assert [(r.href, r.anchor) for r in other] == [("p?a=1&b=2", "u"), ("bare", "v")]
    cases = [("http://h/a/b.html", "c.html"), ("http://h/a/b.html", "/c"), ("http://h", "c"), ("http://h/a/", "?q=1"), ("http://h/a", "//k/z"), ("http://h", "https://z/")]
    assert values(spark, cases, urls.resolve, "string,string") == ["http://h/a/c.html", "http://h/c", "http://h/c", "http://h/a/?q=1", "http://k/z", "https://z/"]
    found = values(spark, ['<a href="/x">Um <b>dois</b></a> <a class="k" href="y">z</a>'], urls.links)[0]
    assert [(r.href, r.anchor) for r in found] == [("/x", "Um dois"), ("y", "z")]


def test_years(spark):
    assert values(spark, ["list_2022b", "notes 2029, notes 2011", "x-32021"], years.inside) == [[2022], [], []]
    assert values(spark, ["from 2029 back to 2011"], years.outside) == [[2011, 2029]]
    cases = ["https://h2020.org/x?y=2023", "http://h/2023/a.pdf?ref=2018", "http://h/docs/2017/a.pdf", "http://h/2021-1/x.pdf"]
    assert values(spark, cases, years.inside_path) == [[], [2023], [], [2021]] and values(spark, cases, years.outside_path) == [[], [], [2017], []]
    urls_ = ["http://h/2020/one.pdf", "http://h/two/2022-3/x.pdf", "http://h/2025_b/f.pdf", "http://h/2020/2021.pdf", "http://h/y", "http://h/2012", "http://h/k-32021.pdf"]
    assert values(spark, urls_, years.provisional) == [2020, 2022, 2025, None, None, None, None]
    dates = ["D:20211103", "D:20200229120000Z", "2024-07-01", "D:20120101", "no date", None]
    assert values(spark, dates, years.pdf_date) == [2021, 2020, 2024, None, None, None]
    page = '<time datetime="2024-01-05">5 jan</time><span class="post-date big">em 2021</span><p>2020</p><time>2023</time>'
    assert values(spark, [page, None], years.html_dates) == [[2021, 2023, 2024], []]
    assert values(spark, ["<time datetime='2022-02-02'>x</time><b class='created z'>2020</b><i class=updated>2019</i>"], years.html_dates) == [[2019, 2020, 2022]]


def test_off_peak(spark):
    assert values(spark, [0, 359, 360, 1319, 1320], lambda m: years.off_peak(m, 1320, 360), "int") == [True, True, False, False, True]
    assert values(spark, [59, 60, 119, 120], lambda m: years.off_peak(m, 60, 120), "int") == [False, True, True, False]


def test_scanned(spark):
    assert values(spark, [(200, 2), (199, 2), (198, 2), (0, 0)], rules.scanned, "int,int") == [False, True, True, True]


def test_fold_is_exact_for_the_whole_plane(spark):
    every = [c for c in map(chr, range(1, 0x10000)) if not 0xD800 <= ord(c) < 0xE000] + ["𝐀", "ＡÉ…", "ΟΔΟΣ", "각ß한글½", "ไทย ั"]
    rows = spark.createDataFrame(list(enumerate(every)), "i int, c string")
    found = rows.select("c", X.fold(F.col("c")).alias("f")).collect()
    plain = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
    assert [(hex(ord(r.c[0])), r.f) for r in found if r.f != plain(r.c)] == []
    assert rows.select(X.fold(F.lit(None).cast("string")).alias("f")).first().f is None
