"""Readers, writers, configuration and incremental stages."""

import json

import pytest

from folioscope.sources import files
from folioscope.streaming import incremental


def test_text_corpus(spark, tmp_path):
    for folder, name, raw in (("a", "0123456789ab", b"um"), ("b", "0123456789ab", b"dois"), ("a", "nao", b"x"), ("a", "ffffffffffff", b"\xff" + b"y" * 9000)):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.txt").write_bytes(raw)
    found = {r.doc_id: r.text for r in files.text_corpus(spark, str(tmp_path)).collect()}
    assert found["0123456789ab"] == "dois" and set(found) == {"0123456789ab", "ffffffffffff"} and len(found["ffffffffffff"]) == 8000
    ids = spark.createDataFrame([("0123456789ab",), ("000000000000",)], "doc_id string")
    assert {r.doc_id: r.text for r in files.texts_of(ids, files.text_corpus(spark, str(tmp_path))).collect()} == {"0123456789ab": "dois", "000000000000": ""}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "á"), (2, None)], "id int, t string")
    files.write_listing(rows, str(tmp_path / "l"), ["id", "t"])
    files.write_listing(rows.limit(0), str(tmp_path / "e"), ["id", "t"])
    read = lambda d: "".join(p.read_text() for p in (tmp_path / d).glob("part-*"))
    assert read("l").splitlines()[0] == "id,t" and read("e").strip() == "id,t"


def test_configuration():
    raw = b'[[instituicao]]\nsigla="A"\nnome="x"\n[[instituicao.portal]]\nnome="p"\ncategoria="integra"\nurl="http://a"\nseeds=["s1","s2","s1"]\n[[instituicao]]\nsigla="a"\nnome="y"\n'
    tree, digest = files.read_config(raw, "toml")
    rows, problems = files.portal_map(tree)
    assert [r["seed"] for r in rows] == ["s1", "s2", "s1"] and len(digest) == 64
    assert problems == ["institution A occurs 2 times", "seed s1 occurs 2 times"]
    with pytest.raises(files.ConfigError):
        files.portal_map({"outro": 1})
    assert files.read_config(json.dumps({"a": 1}).encode(), "json")[0] == {"a": 1}


def test_robots():
    robots = "User-agent: *\nCrawl-delay: 1\n\nUser-agent: Foo\nUser-agent: Bar\nCrawl-delay: 2.5 # x\n"
    assert files.crawl_delay(robots, "bar/1.0") == 2.5 and files.crawl_delay(robots, "z") == 1.0 and files.crawl_delay("", "z") is None


def test_incremental_upsert_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "url string, v int"
    for k in range(2):
        spark.createDataFrame([("a", 1), ("b", 2 + k)], schema).write.mode("append").parquet(src)
        rows = incremental.arrivals(spark, src, spark.createDataFrame([], schema).schema)
        incremental.run_available(rows, incremental.versioned_upsert(out, ["url"]), str(tmp_path / "ck"))
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b"]
