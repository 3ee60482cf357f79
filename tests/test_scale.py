"""Operators that must not gather a key's rows, against plain loops, with one key holding every row too."""

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import citations, joins, mining, neighbours, rules, runs, stages

HIT = "status <=> 403"


def plain_runs(rows):
    found, last = {}, defaultdict(int)
    for host, at, i, status in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        last[host] = last[host] + 1 if status == 403 else 0
        found[i] = last[host]
    return found


@pytest.mark.parametrize("hosts,fan,width,share", [(1, 64, 3.0, 0.5), (1, 2, 1.0, 0.9), (4, 3, 7.0, 0.7), (3, 64, 1e9, 0.6), (1, 2, 4.0, 1.0)])
def test_runs_are_loops(spark, monkeypatch, hosts, fan, width, share):
    monkeypatch.setattr(runs, "FAN", fan)
    r = random.Random(hosts * fan)
    rows = [(r.randrange(hosts) or None, None if i == 9 else r.randint(-50, 200), i, 403 if r.random() < share else r.choice([200, None])) for i in range(400)]
    events = spark.createDataFrame(rows, "host int, at int, id int, status int")
    want = plain_runs(rows)
    assert {x.id: x.run for x in rules.consecutive(events, "host", ["at", "id"], F.expr(HIT), width).collect()} == want
    most = defaultdict(int)
    for host, _, i, _ in rows:
        most[host] = max(most[host], want[i])
    assert {x.host: x.longest for x in rules.suspended(events, "host", ["at", "id"], F.expr(HIT), 3, width).collect()} == {h: n for h, n in most.items() if n >= 3}
    assert rules.consecutive(events.limit(0), "host", ["at", "id"], F.expr(HIT)).count() == 0


def test_runs_over_times_and_reachable_targets(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a" if i < 40 else "b", t0 + dt.timedelta(hours=7 * i), 403 if i < 40 or i % 2 else 200) for i in range(80)]
    events = spark.createDataFrame(rows, "host string, ts timestamp, status int")
    for e in (events, events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))):
        assert [tuple(x) for x in rules.suspended(e, "host", ["ts"], F.expr(HIT)).collect()] == [("a", 40)]
    targets = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "host string, id int")
    assert {x.id for x in rules.reachable(targets, events, "host", ["ts"], F.expr(HIT)).collect()} == {2, 3}


def plain_captures(rows):
    last, first, out = {}, {}, {}
    for portal, url, digest, seq in sorted(rows, key=lambda r: r[3]):
        if url in last:
            out[seq] = ("restaurado" if last[url] == digest else "nova_versao", None)
        else:
            known = first.get((portal, digest))
            out[seq] = ("alias", known) if known else ("novo", None)
        last[url] = digest
        first.setdefault((portal, digest), url)
    return out


@pytest.mark.parametrize("urls,hashes", [(500, 1), (1, 5), (1, 1), (40, 12), (500, 400)])
def test_captures_are_loops(spark, urls, hashes):
    r = random.Random(urls + hashes)
    rows = [(r.randrange(2), f"u{r.randrange(urls)}", r.choice([f"h{r.randrange(hashes)}"] * 20 + [None]), i) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = stages.captures(spark.createDataFrame(rows, "portal_id int, url string, hash string, seq int")).collect()
        assert {x.seq: (x.action, x.refers_to) for x in found} == plain_captures(rows) and len(found) == 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_frequent_keys_stay_where_they_are(spark):
    rows = spark.createDataFrame([(1 if i % 3 else None, i) for i in range(3000)] + [(k, k) for k in range(5000, 5400)], "k int, v int")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    found = joins.attached(rows, table, ["k"], "n", share=10)
    assert found.count() == rows.count() and found.where("low IS NULL").count() == 0
    assert found.where("k IS NULL").select("low").distinct().collect()[0].low == 0


def plain_hits(quotes, texts):
    fold = lambda t: " ".join(t.lower().replace("ß", "ss").split())
    found = set()
    for q, quote in quotes.items():
        for d, t in texts:
            needle = fold(quote or "")
            if not needle or t is None or needle not in fold(t):
                continue
            at, page, done = fold(t).index(needle), 1, 0
            for page, part in enumerate(t.split("\n"), 1):
                size = len(fold(part))
                done += size + 1 if size and done else size
                if done > at:
                    break
            found.add((q, d, page))
    return found


def test_citations_find_every_quote(spark):
    r = random.Random(3)
    words = ["a", "bc", "Straße", "NÃO", "x1", "fim.", "e", "longer"]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\n\n"]) for _ in range(n))
    texts = [(i, say(r.randint(0, 60))) for i in range(60)] + [(7, "a bc a bc"), (90, None), (91, ""), (92, "zz")]
    quotes = {i: say(r.randint(0, 7)).strip() for i in range(120)} | {200: None, 201: "", 202: "z", 203: "zz", 204: "zzz", 205: "ong", 206: "ger\tA", 207: "R"}
    quotes |= {300 + i: texts[i][1][3:-3] for i in range(20)}
    table = spark.createDataFrame(texts, "doc_id long, text string")
    found = [tuple(x) for x in citations.hits(spark.createDataFrame(list(quotes.items()), "quote_id long, quote string"), table).collect()]
    assert set(found) == plain_hits(quotes, texts) and len(found) > 200
    twice = citations.hits(spark.createDataFrame([(1, "zz")], "quote_id long, quote string"), table.union(table))
    assert sorted(map(tuple, twice.collect())) == [(1, 92, 1)] * 2
    assert citations.hits(spark.createDataFrame([(1, " ")], "quote_id long, quote string"), table).collect() == []


def plain_neighbours(weights, k):
    vectors = defaultdict(dict)
    for d, t, w in weights:
        vectors[d][t] = w
    out = set()
    for d, v in vectors.items():
        near = sorted((-round(sum(w * u.get(t, 0) for t, w in v.items()), 6), o) for o, u in vectors.items() if o != d)
        out.update((d, i + 1, o, -c) for i, (c, o) in enumerate([x for x in near if x[0] < 0][:k]))
    return out


@pytest.mark.parametrize("docs,terms,k", [(60, 30, 3), (40, 400, 10), (12, 5, 20), (80, 60, 1)])
def test_neighbours_are_exact(spark, docs, terms, k):
    r = random.Random(docs)
    weights = []
    for d in range(docs):
        own = {int(terms * r.random() ** 2): r.random() + 0.01 for _ in range(r.randint(1, 20))}
        norm = math.sqrt(sum(w * w for w in own.values()))
        weights += [(d, f"t{t}", w / norm) for t, w in own.items()]
    weights += [(docs + 1, t, w) for d, t, w in weights if d == 0] + [(docs + 2, "alone", 1.0)]
    found = [tuple(x) for x in neighbours.neighbours(spark.createDataFrame(weights, "doc_id long, term string, weight double"), k).collect()]
    assert set(found) == plain_neighbours(weights, k) and len(found) == len(set(found))


@pytest.mark.parametrize("docs,terms,k,size", [(60, 30, 3, 2048), (90, 40, 4, 16), (12, 5, 20, 4), (80, 60, 1, 7), (150, 9, 5, 10)])
def test_neighbours_by_tiles_are_exact(spark, monkeypatch, docs, terms, k, size):
    """Pairs of blocks, columns in parts, groups of more copies than k, and a document that shares no term."""
    for name, value in (("PRODUCTS", -1), ("PRODUCTS_A_ROW", 0), ("SIZE", size), ("WIDTH", 7 if docs % 20 else 2048), ("FIRST", 3)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours, "_by_index", None)
    r = random.Random(docs + k)
    weights = []
    for d in range(docs):
        own = {int(terms * r.random() ** 2): r.randint(1, 3) for _ in range(r.randint(1, 8))}
        norm = math.sqrt(sum(w * w for _, w in sorted(own.items())))
        weights += [(d * 3, f"t{t}", w / norm) for t, w in own.items()]
    weights += [(3 * docs + 1 + i, t, w) for i in range(9) for d, t, w in weights if d == 30] + [(1, t, w) for d, t, w in weights if d == 33] + [(2, "alone", 1.0)]
    found = [tuple(x) for x in neighbours.neighbours(spark.createDataFrame(weights, "doc_id long, term string, weight double"), k).collect()]
    assert set(found) == plain_neighbours(weights, k) and len(found) == len(set(found))


def test_neighbours_prune_pairs(spark, monkeypatch):
    """Groups of like documents that share a frequent term with all others: pairs across groups are not summed."""
    texts = [(g * 8 + i, f"comum comum {' '.join(f'g{chr(97 + g)}{chr(97 + w)}' for w in range(12))} s{chr(97 + g)}{chr(97 + i)}") for g in range(12) for i in range(8)]
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    written = []
    monkeypatch.setattr(neighbours, "kept", lambda rows, keep=neighbours.kept: written.append(keep(rows)) or written[-1])
    found = neighbours.neighbours(mining.tfidf(corpus, min_df=1, max_df=1.0), 5).collect()
    assert len(found) == 96 * 5 and all(r.other // 8 == r.doc_id // 8 for r in found)
    assert written[-1].count() == 96 * 7


def test_projection_makes_no_row_a_pair_of_terms(spark, monkeypatch):
    """Vectors are multiplied in the tasks; the coordinates are those of the matrix's two main axes."""
    monkeypatch.setattr(mining, "BATCH", 8, raising=False)
    r = random.Random(5)
    full = np.zeros((50, 37))
    for d in range(50):
        for t in range(37):
            full[d, t] = r.random() if r.random() < (0.7 if t % 3 == d % 3 else 0.1) else 0
    full /= np.sqrt((full * full).sum(axis=1, keepdims=True))
    weights = spark.createDataFrame([(d, f"t{t:02}", float(full[d, t])) for d in range(50) for t in range(37) if full[d, t]], "doc_id long, term string, weight double").repartition(3)
    join = type(weights).join

    def once(own, other, *args):
        assert not ("doc_id" in own.columns and "doc_id" in other.columns)
        return join(own, other, *args)

    monkeypatch.setattr(type(weights), "join", once)
    found = {x.doc_id: (x.x, x.y) for x in mining.project_2d(weights).collect()}
    axes = np.linalg.svd(full - full.mean(axis=0))[2][:2]
    want = full @ (axes * np.where(axes[[0, 1], np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]).T
    assert len(found) == 50 and np.allclose([found[d] for d in range(50)], want, atol=1e-9)
    assert mining.project_2d(weights.limit(0)).count() == 0
