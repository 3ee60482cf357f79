"""Page differencing as a whole: a plain version over lists, and what decides on the driver's pages."""

import os
import random
import re
from itertools import groupby

import pytest

from folioscope.llm import mainart

PAGES = "/root/testdata/sf0.01/pages.parquet"


def plain_extract(pages):
    """(page_id, url, text) by sorting whole hosts and looking at each page with both neighbours."""
    def key(p):
        url = p[1] or ""
        host = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
        path = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", url)
        return (host[1].lower().encode() if host else b"", path[1].encode() if path else b"", p[1] is not None, url.encode(), p[0])

    out = []
    for _, group in groupby(sorted(pages, key=key), lambda p: key(p)[0]):
        own = list(group)
        found = [mainart.blocks(p[2] or "") for p in own]
        lines = [mainart.shared(a, b) for a, b in zip(found, found[1:])]
        places = [mainart.aligned(a, b) for a, b in zip(found, found[1:])]
        n = len(own)
        lost = [set()] * n  # blocks that a page with two neighbours loses inside its article
        for i in range(1, n - 1):
            lost[i] = mainart.little(found[i], lines[i - 1][1]) & mainart.little(found[i], lines[i][0])
        for i in range(n):
            near_lines = ([lines[i - 1][1]] if i else []) + ([lines[i][0]] if i + 1 < n else [])
            near_places = ([places[i - 1][1]] if i else []) + ([places[i][0]] if i + 1 < n else [])
            inside = lost[i]
            if len(near_lines) == 1 and n > 2:
                other = 1 if i == 0 else n - 2
                gone = {found[other][k].line() for k in lost[other]}
                inside = {k for k in mainart.little(found[i], near_lines[0]) if found[i][k].line() in gone}
            text = mainart.kept(found[i], set().union(*near_lines), inside, set.intersection(*near_places) if near_places else set())
            out.append((own[i][0], own[i][1], text))
    return out


def extracted(spark, pages, **options):
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    return [(r.page_id, r.url, r.text) for r in mainart.extract(table, **options).collect()]


@pytest.mark.parametrize("range_pages", [2, 1000])
def test_extraction_is_the_plain_version(spark, range_pages):
    r = random.Random(range_pages)
    words = lambda n: " ".join(r.choice("uno dos tres quatro cinco seis sete oito".split()) for _ in range(n))
    part = lambda: r.choice([f"<div class='menu m{r.randint(1, 9)}'><a>{words(2)}</a></div>", f"<p>{words(r.randint(1, 12))}</p>", "<p>Shared.</p>", f"<div class=text><p>{words(30)}<p>{words(20)}</div>", f"<section>{words(3)}</section>", "<aside>x</aside>"])
    pages = []
    for i in range(120):
        inner = "".join(part() for _ in range(r.randint(0, 7)))
        html = f"<body><div id=top>{words(2)}</div>" + (f"<article><h1>{words(3)}</h1>{inner}</article>" if i % 3 else inner) + f"<div class=end>{r.choice(['Rights', words(3)])}</div>"
        pages.append((i, r.choice([f"http://h{r.randint(0, 4)}.org/{r.randint(0, 40)}", f"https://H0.org/{i}?q", None]), html if i % 17 else None))
    pages += pages[:5]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        found = extracted(spark, pages, range_pages=range_pages)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    # pages that are equal in all of the order's columns are neighbours in some order
    assert sorted(map(str, found)) == sorted(map(str, plain_extract(pages)))


def test_menus_and_adverts_whose_words_change(spark):
    """No article element and no telling names: the element that holds most of what differs is the page's content."""
    page = lambda i: f"<body><div class=qa><ul><li>m{i}a</li><li>m{i}b</li></ul></div><div class=qb>Buy {i} now</div><div class=qc><h1>Title {i}</h1><p>{'long text ' * 20}{i}.</p><p>More {i}.</p></div><div class=qd>{i} rights</div></body>"
    found = {a: t for a, _, t in extracted(spark, [(i, f"http://a.org/{i}", page(i)) for i in range(6)] + [(9, "http://b.org/9", page(9))])}
    for i in range(6):
        assert found[i] == f"Title {i}\n{('long text ' * 20).strip()} {i}.\nMore {i}.".replace("  ", " ")
    assert "Buy 9 now" in found[9]  # no neighbour


def test_pages_of_one_url_long_and_repeated(spark):
    body = lambda i: "<article>" + "".join(f"<p>word {i} {k}.</p>" for k in range(3000)) + "</article><footer>f</footer>"
    pages = [(1, "http://a/x", body(1)), (2, "http://a/x", body(2)), (2, "http://a/x", body(2)), (3, "http://a/x", body(3))]
    found = extracted(spark, pages)
    assert len(found) == 4 and all(t == "\n".join(f"word {i} {k}." for k in range(3000)) for i, _, t in found)
    assert extracted(spark, []) == []


@pytest.mark.skipif(not os.path.exists(PAGES), reason="the driver's pages")
def test_differencing_decides_on_the_given_pages(spark, monkeypatch):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(PAGES).collect()]
    whole = {a: t for a, _, t in plain_extract(pages)}

    def changed():
        now = {a: t for a, _, t in plain_extract(pages)}
        return sum(now[k] != whole[k] for k in whole)

    took = []
    real = mainart.differenced
    monkeypatch.setattr(mainart, "differenced", lambda page, *a: took.append((len(page), len(real(page, *a)))) or real(page, *a))
    plain_extract(pages)
    assert sum(gone > 0 for _, gone in took) > 0.9 * len(pages)
    monkeypatch.undo()
    monkeypatch.setattr(mainart, "NAMES", frozenset())
    assert changed() == 0
    monkeypatch.setattr(mainart, "FURNITURE", frozenset())
    assert changed() == 0
    monkeypatch.setattr(mainart, "MAIN", ())
    assert changed() < 0.2 * len(pages)  # those without neighbours, mostly
