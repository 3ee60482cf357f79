"""Each operator against a plain version of its contract, on small tables with nulls, empty and long texts, ties and clashing names."""

import base64
import binascii
import hashlib
import html as html_lib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from folioscope.llm import bpe, chat, components, decontaminate, mainart, neardup, quality, queries, sstable, substring, toxicity, warc  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, TIE int, row string, key int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n)]
    for i in range(9, n, 10):
        out[i] += "."
    return " ".join(out)


def rows(texts, first=0):
    """Rows with extra columns whose names clash with inner ones."""
    return [(first + i, t, "en", f"src{i % 2}", None if t is None else len(t), "x", 1, "r", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    words = base.split()
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(words))
    return [base, None, "", " \t\n ", base, near, "Two words", prose(2, 120) + "\n" + prose(3, 80), "Été ß 中文  x y  z\n\n", prose(4, 60) + "\n" + prose(3, 80), "a" * 3000, prose(5, 6000), "<|endoftext|> it's 12 o'clock"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1: byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def rank_map():
    return queries.rank_map()


def test_bpe_matches_the_library(docs, texts, ranks, rank_map):
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in bpe.report(docs, rank_map, public_tokenizers.PATTERN, hot=50).collect()}
    for i, t in enumerate(texts):
        ids = tool.encode_ordinary(t or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_cache_changes_nothing(docs, rank_map):
    few = docs.where("doc_id < 10")
    a, b = (sorted(map(tuple, bpe.report(few, rank_map, public_tokenizers.PATTERN, hot=h).collect())) for h in (1, 1000))
    assert a == b


def test_bpe_ids_and_decode(docs, texts, rank_map):
    out = bpe.decode(bpe.encode(docs.unionAll(docs), rank_map, public_tokenizers.PATTERN, hot=10), rank_map)
    found = [(r.doc_id, r.row, bytes(r.decoded).decode()) for r in out.collect()]
    assert sorted(found) == sorted([(i, "r", t or "") for i, t in enumerate(texts)] * 2)


def test_bpe_repeated_ids_and_rows(spark, rank_map, ranks):
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows_ = [(1, "zwrkq, vvpli zwrkq"), (1, "another qqzzvv"), (1, "zwrkq, vvpli zwrkq"), (None, "nulls qqzzvv"), (None, None), (2, "a,b,,c , 中文,字")]
    found = bpe.report(spark.createDataFrame(rows_, "doc_id long, text string"), rank_map, public_tokenizers.PATTERN, hot=2).collect()
    want = [(i, hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()) for i, t in rows_ for ids in [tool.encode_ordinary(t or "")]]
    assert sorted(((r.doc_id, r.ids_sha256) for r in found), key=str) == sorted(want, key=str)


def test_bpe_very_long_words(spark, rank_map, ranks):
    """A word of a megabyte, and words around the length from which the heap takes over."""
    import tiktoken

    tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(8)
    words = ["".join(chr(r.randint(0x4E00, 0x4FFF)) for _ in range(n)) for n in (84, 85, 86, 87, 350_000)] + ["".join(r.choice("abcde") for _ in range(n)) for n in (255, 256, 257, 600)]
    found = {x.doc_id: x.ids_sha256 for x in bpe.report(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), rank_map, public_tokenizers.PATTERN, hot=20).collect()}
    for i, t in enumerate(words):
        ids = tool.encode_ordinary(t)
        assert found[i] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_bpe_shared_keys_change_nothing(docs, rank_map, monkeypatch):
    few = docs.where("doc_id < 10")
    a = sorted(map(tuple, bpe.report(few, rank_map, public_tokenizers.PATTERN, hot=3).collect()))
    monkeypatch.setattr(bpe, "KEY_BITS", 1)
    assert a == sorted(map(tuple, bpe.report(few, rank_map, public_tokenizers.PATTERN, hot=3).collect()))


def test_hot_words_are_found_by_bytes(tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"number": [1, 0, 2], "word": ["ab", "xy", "ba"], "code": [bpe.char(5), bpe.char(7) + bpe.char(8), bpe.char(9)]}), tmp_path / "a.parquet")
    for weak in (False, True):
        if weak:  # all words of a length share a hash
            monkeypatch.setattr(bpe, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
        tool = bpe.HotWords(f"file://{tmp_path}", [])
        held = tool.held(["k", None], pa.array([["xy", "no", "ab", "xy"], []], pa.list_(pa.string())))
        assert held[1] == [None, ""] and (weak or held[0] == ["k", bpe.char(0) + bpe.MARK + bpe.char(1) + bpe.char(0), "no"])
        codes = [[bpe.char(i) + bpe.MARK + w for i, w in enumerate(("no", "ab", "xy", "ba"))], None]
        assert weak or [x.tolist() for x in tool.ids(held, codes)] == [[7, 8, 0, 5, 7, 8], []]
        assert [x for x, c in zip(held[0][1], "abcd") if x != bpe.MARK].count(bpe.char(0)) in (0, 1, 2) and held[0][1].count(bpe.MARK) == len(held[0]) - 2
        monkeypatch.setattr(bpe, "MOST", 1)
        assert weak or [x.tolist() for x in tool.ids(held, codes)] == [[7, 8, 0, 5, 7, 8], []]
        monkeypatch.undo()


def test_bpe_empty_table(empty, rank_map):
    assert bpe.report(empty, rank_map, public_tokenizers.PATTERN, hot=10).count() == 0


# ---- 2: sorted string tables


def test_sstable_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    found = {r.doc_id: r for r in sstable.write_and_read(docs, path, 2).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_sstable_lookup():
    stream = io.BytesIO()
    writer = sstable.Writer(stream, 2)
    keys = [None, -5, -5, *range(0, 60000, 3)]
    for k in keys:
        writer.add(sstable.key_of(k), np.array([k or 7, 2]).astype("<u2").tobytes() * 20)
    writer.close()
    reader = sstable.Reader(io.BytesIO(stream.getvalue()))
    assert len(reader.place) > 3 and [k for k, _ in reader] == keys
    assert len(reader.get(-5)) == 2 and len(reader.get(None)) == 1 and reader.get(1) == [] and reader.get(29997)[0][0] == 29997
    assert sum(reader.maybe(k) for k in range(1, 60000, 3)) < 1000


def test_sstable_encoder_is_the_library():
    tool = sstable.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tool.memory.limit = 300
    r = random.Random(3)
    parts = ["a", "b ", " ", "\n", "  ", "\t", "\x1c", "\x85", "\xa0", "é", ",", ".", "'s", "1", "²", "\x00", "<|endoftext|>", "ß", "中", "x,", "y.", "!!"]
    docs = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    docs += [" ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(30)) for _ in range(300)]
    got = [x for i in range(0, len(docs), 50) for x in tool.encode(pa.array(docs[i : i + 50], pa.string()))]
    assert len(tool.memory.hash) <= 400
    for d, g, w in zip(docs, got, tool.library.encode_batch(docs, add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u2").tolist() == w.ids, d


def test_sstable_encoder_where_hashes_agree(monkeypatch):
    weak = lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(4)
    monkeypatch.setattr(sstable, "span_hashes", weak)
    tool = sstable.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (["a few words", "other words here"], ["", "one"], ["two"], ["x" * 7, "y" * 7]):
        got = tool.encode(pa.array(docs, pa.string()))
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [w.ids for w in tool.library.encode_batch(docs, add_special_tokens=False)]


def test_sstable_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        sstable.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_sstable_ties_and_empty(spark, empty):
    two = spark.createDataFrame([(None, "a"), (3, "b c"), (3, "d"), (3, "d")], "doc_id long, text string")
    out = sorted((r.start, r.doc_id if r.doc_id is not None else -1) for r in sstable.write_and_read(two, public_tokenizers.path("byte_bpe_50k.json"), 2).collect())
    assert [x[1] for x in out] == [-1, 3, 3, 3] and out[0][0] == 0
    assert sstable.write_and_read(empty, public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0


# ---- 3: page differencing

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu {0}</a></ul></nav>
<div class="ad">Buy {0}</div><article><header><h1>Title &amp; {0}</h1></header><p><b>One&nbsp; two<br>three<p>Shared passage.</p><aside>side</aside><form>f</form>
<div class="comments">nice</div></article><footer>foot</footer></body>"""


def test_extraction_with_article(spark):
    pages = spark.createDataFrame([(i, f"https://h.org/p/{i}", PAGE.format(i), 1) for i in range(6)] + [(7, None, None, 1), (8, "https://h.org/p/9", "", 1)], "page_id long, url string, html string, HOST int")
    found = {r.page_id: r for r in mainart.extract(pages).collect()}
    assert len(found) == 8 and found[7].text == found[8].text == "" and found[7].n_chars == 0
    for i in range(6):
        assert found[i].text == f"Title & {i}\nOne two three\nShared passage." and found[i].n_chars == len(found[i].text)


def test_extraction_by_differencing(spark):
    page = "<div>Site name</div><div>Home | About</div><div>Own text {0}.</div><p>More of {0}.</p><div>All rights reserved</div>"
    pages = spark.createDataFrame([(i, f"http://x.net/a/{i}", page.format(i)) for i in range(5)] + [(9, "http://y.net/a", page.format(9))], "page_id long, url string, html string").coalesce(1)
    found = {r.page_id: r.text for r in mainart.extract(pages).collect()}
    assert {i: found[i] for i in range(5)} == {i: f"Own text {i}.\nMore of {i}." for i in range(5)}
    assert found[9].startswith("Site name")  # no neighbour on its host


@pytest.mark.parametrize("range_pages", [1, 3, 1000])
def test_extraction_meets_both_neighbours_at_every_bound(spark, range_pages):
    page = "<div>Site name</div><div>Home | About</div><div>Own text {0}.</div><div>Rights {1}</div>"
    pages = spark.createDataFrame([(i, f"http://x.net/a/{i:02d}", page.format(i, i // 2)) for i in range(24)] + [(99, "http://y.net/a", page.format(99, 99))], "page_id long, url string, html string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    try:
        found = {r.page_id: r.text for r in mainart.extract(pages, range_pages=range_pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    assert found == {i: f"Own text {i}." for i in range(24)} | {99: "Site name\nHome | About\nOwn text 99.\nRights 99"}


@pytest.mark.parametrize("range_pages", [1, 1000])
def test_extraction_differences_inside_articles(spark, range_pages):
    notice = lambda i, more="": f"<article><p>Read it in our app</p><p>Text {i}.</p><p>More {i}.</p>{more}</article>"
    copy = "<article><p>Copied.</p><p>From elsewhere.</p></article>"
    data = [(i, f"http://a.org/{i}", notice(i, "<p>Twice only.</p>" if i in (2, 3) else "")) for i in range(6)]
    data += [(10 + i, f"http://b.org/{i}", copy) for i in range(3)] + [(20 + i, f"http://c.org/{i}", notice(i)) for i in range(2)]
    spark.conf.set("spark.sql.shuffle.partitions", 15)
    try:
        found = {r.page_id: r.text for r in mainart.extract(spark.createDataFrame(data, "page_id long, url string, html string"), range_pages=range_pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    for i in range(6):
        assert found[i] == f"Text {i}.\nMore {i}." + ("\nTwice only." if i in (2, 3) else ""), i
    assert {found[10 + i] for i in range(3)} == {"Copied.\nFrom elsewhere."}
    assert found[20].startswith("Read it in our app")  # two pages don't tell a notice from a passage


def test_longest_common_subsequence():
    def length(x, y):
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    r = random.Random(1)
    for _ in range(300):
        x, y = ([r.choice("abc") for _ in range(r.randint(0, 10))] for _ in range(2))
        pairs = mainart.subsequence(x, y)
        assert len(pairs) == length(x, y) and all(x[i] == y[j] for i, j in pairs) and pairs == sorted(pairs)
        a, b = ([mainart.Block("p", t, False, False) for t in z] for z in (x, y))
        in_a, in_b = mainart.shared(a, b)
        assert len(in_a) == len(in_b) == length(x, y)


@pytest.mark.parametrize("html,text", [("<p>a<p>b", "a\nb"), ("a<b>c</b>d", "acd"), ("<ul><li>1<li>2</ul>", "1\n2"), ("x < y &lt;z", "x < y <z"), ("<p>a<!-- b --></p>c", "a\nc"), ("<script>a", ""), ("<table><tr><td>1<td>2</table>", "1\n2"), ("<p hidden>a</p>b", "b"), ("&am &ampx", "&am &x")])
def test_blocks(html, text):
    assert mainart.kept(mainart.blocks(html), set()) == text


# ---- 4: near duplicates


def plain_components(texts, percent=75):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_match_brute_force(spark, docs, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert found == plain_components(texts)
    kept = {r.doc_id for r in neardup.keep_one(docs).collect()}
    assert kept == {i for i, x in plain_components(texts).items() if x[2]} and neardup.keep_one(docs).columns == docs.columns


def test_near_duplicate_group_around_the_threshold(spark):
    """A group of edited copies, similar to the base but not always to each other."""
    r = random.Random(5)
    base = prose(9, 150).split()
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 9999)}"
        texts.append(" ".join(w))
    texts += [prose(100 + i, 80) for i in range(20)]
    r.shuffle(texts)
    found = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert found == plain_components(texts)


def test_superminhash_estimates():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    text, hashed = np.repeat([0, 1, 2], [750, 750, 3]), np.concatenate([a[:750], a[250:], a[:3]])
    values = neardup.signatures(text, hashed, 3)
    assert abs((values[0] == values[1]).mean() - 0.5) < 0.15 and len(set(values[2].tolist())) == neardup.SLOTS


def test_near_duplicates_ties_and_empty(spark, empty):
    out = [tuple(r) for r in neardup.near_duplicates(spark.createDataFrame([(None, "a b"), (4, "x y"), (4, "x y"), (2, "x y")], "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted([(None, 1, None, True), (4, 1, 2, False), (4, 1, 2, False), (2, 1, 2, True)], key=str)
    assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("small", [components.SMALL, 0])
def test_components_of_chains(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200)]
    found = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and {found[i] for i in (100, 101, 102)} == {100} and 200 not in found


# ---- 5: WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 100_000), (5, "u", "x" * 100_000), (None, "u", "y")]
    out = sorted(map(tuple, warc.write_and_read(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()), key=str)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = min(p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None) if i is not None else None
        revisit = i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert out == sorted(want, key=str)
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("members", [1, 3])
def test_warc_normaliser(members):
    records = [warc.record(i, "http://a/", b"payload %d" % i * 50_000, "D", None, False) for i in range(6)]
    packs = [records] if members == 1 else [records[i::3] for i in range(3)]
    raw = b""
    for p in packs:
        tool = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw += tool.compress(b"".join(p)) + tool.flush()
    target, side = io.BytesIO(), io.BytesIO()
    assert warc.normalise(io.BytesIO(raw), target, side) == 6
    index = warc.read_index(side.getvalue())
    assert [warc.page_of(x[2]) for x in index] == [i for p in ([range(6)] if members == 1 else [range(6)[i::3] for i in range(3)]) for i in p]
    head, http, payload = warc.read_record(target, *index[3][:2])
    assert payload.startswith(b"payload %d" % warc.page_of(index[3][2])) and int(http["content-length"]) == len(payload)
    assert b"".join(zlib.decompress(target.getvalue()[o : o + n], 31) for o, n, _ in index) == b"".join(r for p in packs for r in p)
    with pytest.raises(ValueError):
        warc.normalise(io.BytesIO(zlib.compress(records[0][:-9], wbits=31)), io.BytesIO(), io.BytesIO())


# ---- 6: toxicity


def test_toxicity_generalises_to_misspellings(spark):
    r = random.Random(2)
    bad = ["stinkhead", "dumbbrick", "foulmouth"]
    data, labels = [], []
    for i in range(400):
        w = prose(1000 + i, r.randint(20, 150)).split()
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad)
        data.append((i, " ".join(w), "en", "src0", 1))
        labels.append((i, 1, int(toxic)))
    data += [(1000, prose(5, 60) + " stinkheads", "en", "s", 1), (1001, prose(6, 60), "en", "s", 1), (1002, None, "en", "s", 1), (1003, "", "en", "s", 1), (None, "a", "en", "s", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, SCORE int")
    found = {x.doc_id: x for x in toxicity.fit_and_score(docs, spark.createDataFrame([*labels, (3, 1, None)], "doc_id long, quality int, toxic int")).collect()}
    assert len(found) == len(data) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in found.values())
    assert found[1000].score > 0.3 > found[1001].score and found[1002].score == found[1003].score
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in found.items() if i is not None) and not found[None].held_out
    held = [(x.score >= 0.3) == (i % 4 == 0) for i, x in found.items() if i is not None and i < 400 and x.held_out]
    assert sum(held) / len(held) > 0.9


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 1e-6 for r in toxicity.fit_and_score(docs, none).collect()} == {True}
    assert toxicity.fit_and_score(empty, none).count() == 0


# ---- 7: decontamination


def plain_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").encode().lower().decode())
    w, hit, found = low(text), set(), set()
    for name, t in items:
        p = low(t)
        n = min(10, len(p))
        for k in range(len(p) - n + 1 if n else 0):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == p[k : k + n]:
                    hit.update(range(a, a + n))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination_matches_brute_force(spark, texts, block):
    items = [(10, prose(3, 80)), (2, "TWO, words!"), (7, None), (8, ""), (9, "lambda"), (11, " ".join(prose(5, 6000).split()[700:725])), (12, prose(77, 30)), (13, "two words"), (14, "été ß")]
    own = [*texts, "one Two-words\x7fTWO words lambda two"]
    docs = spark.createDataFrame(rows(own), SCHEMA)
    found = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()}
    assert found == {i: plain_hits(t, items) for i, t in enumerate(own)}


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_decontamination_keeps_repeated_rows(spark, block):
    items = spark.createDataFrame([(i, prose(300 + i, 40)) for i in range(4)], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(310, 30))] * 3 + [(2, prose(300, 40))] * 2 + [(None, None)] * 2, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.contaminated) for r in decontaminate.report(docs, items, block_bytes=block).collect()) == [("1", False)] * 3 + [("2", True)] * 2 + [("None", False)] * 2
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, items, block_bytes=block).collect()) == ["1"] * 3 + ["None"] * 2


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.report(docs, none).collect()} == {False}
    assert decontaminate.report(empty, none).count() == 0
    assert decontaminate.clean(docs, none).columns == docs.columns


# ---- 8: quality rules


def plain_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)


def test_repeat_words_where_hashes_share_bits(spark, texts, monkeypatch):
    many = [*texts, " ".join("abc"[i * i % 3] for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    count = lambda: [r.n for r in docs.select("doc_id", quality.figures(F.col("text"))["n_repeat_words"].alias("n")).orderBy("doc_id").collect()]
    want = count()
    assert want[5] == 0 and want[-1] > 390
    monkeypatch.setattr(quality, "PLACE_BITS", 60)
    monkeypatch.setattr(quality, "PLACES", 1 << 60)
    assert count() == want
    monkeypatch.setattr(quality, "PLACES", 3)
    assert count() == want


def test_quality_matches_brute_force(spark, texts):
    own = [*texts, "spam " * 100, "a b c d e f g h i\n" * 3 + "x # $", prose(3, 40) + "\n" + prose(3, 40) + "\n" + prose(8, 200)]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows(own), SCHEMA)).collect()}
    for i, t in enumerate(own):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), (i, t)
        assert r.kept == (not r.base_failed)


def test_boilerplate_lines(spark, empty):
    limits = quality.Limits(min_docs=5, share=0.1)
    line = "Accept all cookies 2020"
    own = [f"{prose(200 + i, 40)}\n{line if i % 2 else line.replace('2020', '1999')}" for i in range(30)] + ["\n".join([line] * 6)] + [prose(1, 50)] * 12
    docs = spark.createDataFrame([(i, t, "en", "h", 0, "x", 1, "r", 1) for i, t in enumerate(own)], SCHEMA)
    found = {r.doc_id: r for r in quality.judge(docs, limits=limits).collect()}
    assert all(found[i].kept and found[i].n_removed_words == 4 for i in range(30)) and not found[30].kept and all(found[i].kept for i in range(31, 43))
    cleaned = {r.doc_id: r for r in quality.clean(docs, limits=limits).collect()}
    assert 30 not in cleaned and all(cleaned[i].text == prose(200 + i, 40) + "" and cleaned[i].n_chars == len(cleaned[i].text) for i in range(30))
    assert quality.clean(docs).columns == docs.columns and quality.judge(empty).count() == 0


def test_boilerplate_lines_of_any_length(spark):
    limits = quality.Limits(min_docs=5, share=0.1)
    notice = prose(400, 45)
    own = [f"{prose(401 + i, 40)}\n{notice}" for i in range(30)] + [f"{notice}\nalone {i} {'x' * i}" for i in range(3)] + [prose(1, 50)] * 12
    docs = spark.createDataFrame([(i, t, "en", "h", 0) for i, t in enumerate(own)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in quality.judge(docs, limits=limits).collect()}
    assert all(found[i].kept and found[i].n_removed_words == 45 for i in range(30)) and not any(found[i].kept for i in range(30, 33)) and all(found[i].kept for i in range(33, 45))
    assert {r.text for r in quality.clean(docs, limits=limits).where("doc_id < 33").collect()} == {prose(401 + i, 40) for i in range(30)}


# ---- 9: substring deduplication


WIDE = "\u3000-\u9fff\u0e00-\u0e7f"
PLAIN_WORD = re.compile(rf"[{WIDE}]|[^\x00-\x2F\x3A-\x60\x7B-\x7F{WIDE}、。，．：；！？]+")


def plain_units(t):
    """Of each unit its words' spans."""
    low = t.encode().lower().decode()
    units, last = [], None
    for m in PLAIN_WORD.finditer(low):
        if m.group() in "、。":
            continue
        if last is None or re.search(r"[.,;:!?\n、。，．：；！？]", low[last : m.start()]):
            units.append([])
        units[-1].append((*m.span(), m.group()))
        last = m.end()
    return units


def plain_cut(texts, least=25):
    """Windows of three words at least, the earliest occurrence of each, and what is left without runs of later ones."""
    firsts, windows = {}, []
    for d, t in enumerate(texts):
        units = plain_units(t or "")
        own = []
        for i in range(len(units)):
            a, b = i, i + 1
            while b < len(units) and sum(map(len, units[a:b])) < 3:
                b += 1
            while a and sum(map(len, units[a:b])) < 3:
                a -= 1
            key = tuple(w for u in units[a:b] for _, _, w in u)
            if len(key) >= 3:
                firsts.setdefault(key, (d, i))
                own.append((i, a, b, key))
        windows.append((units, own))
    out = []
    for d, t in enumerate(texts):
        units, own = windows[d]
        repeated = set()
        for i, a, b, key in own:
            first = firsts[key]
            if first[0] != d or i - first[1] >= b - a:
                repeated.update(range(a, b))
        left, at, run = "", 0, []
        for n in range(len(units) + 1):
            if n in repeated:
                run.append(n)
            elif run:
                if sum(len(units[x]) for x in run) >= least:
                    left, at = left + t[at : units[run[0]][0][0]], units[n][0][0] if n < len(units) else len(t)
                run = []
        out.append(None if t is None else left + t[at:])
    return out


@pytest.mark.parametrize("least", [1, 4, 25])
def test_substring_matches_brute_force_on_short_units(spark, least):
    r = random.Random(least)
    pieces = ["a b.", "c!", "d e f,", "g.", "Not guilty.", "h i j k l m.", "中文", "字。", "、", "x", "ไทย ", "\n", "A B.", "e f", "é;", "?"]
    own = ["".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    found = {x.doc_id: x.text for x in substring.deduplicate(docs, min_words=least).collect()}
    assert [found[i] for i in range(len(own))] == plain_cut(own, least)


def test_substring_never_cuts_new_words(spark):
    a, b = prose(64, 40), prose(65, 40)
    data = [(1, f"{a} {b}"), (2, f"{a} Not guilty. {b}"), (3, f"{prose(64, 20)} Never. Seen. {b}")]
    found = {x.doc_id: x.text for x in substring.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == {1: f"{a} {b}", 2: "Not guilty. ", 3: f"{prose(64, 20)} Never. Seen. "}


def test_substring_matches_brute_force(spark, texts):
    passage = prose(50, 60)
    own = [*texts, prose(51, 30) + " " + passage + " " + prose(52, 30), f"Ünï {passage.upper()} tail é", passage + "\nTo.\n" + passage]
    docs = spark.createDataFrame(rows(own), SCHEMA)
    out = substring.deduplicate(docs)
    found = {r.doc_id: r for r in out.collect()}
    assert [found[i].text for i in range(len(own))] == plain_cut(own)
    for i, t in enumerate(own):
        left, at = "", 0
        for s in found[i].removed:
            left, at = left + t[at : s.start], s.end
        assert t is None or left + t[at:] == found[i].text
    cleaned = {r.doc_id: r for r in substring.clean(docs).collect()}
    assert 4 not in cleaned and 0 in cleaned and substring.clean(docs).columns == docs.columns


def test_substring_repeated_rows_and_empty(spark, empty):
    t = prose(60, 50)
    out = substring.report(spark.createDataFrame([(1, t), (1, t), (None, None), (2, t)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", t), ("1", t), ("None", None), ("2", "")])
    assert substring.report(empty).count() == 0


@pytest.mark.parametrize("lead", ["", "New! ", "new one, "])
def test_substring_cuts_text_of_short_units(spark, lead):
    passage = "!! ".join(prose(61, 40).replace(".", "").split()) + "!!"
    found = {r.doc_id: r.text for r in substring.report(spark.createDataFrame([(1, passage), (2, f"{lead}{passage}\nOther words end it here.")], "doc_id long, text string")).collect()}
    assert found == {1: passage, 2: f"{lead}Other words end it here."}


def test_substring_keeps_new_short_units(spark):
    passage, new = prose(62, 30), "No. Not. Ever. Seen. Before."
    found = {r.doc_id: r.text for r in substring.report(spark.createDataFrame([(1, passage), (2, f"{passage}\n{new}\n{passage}")], "doc_id long, text string")).collect()}
    assert found == {1: passage, 2: new + "\n"}


def test_substring_cuts_text_without_spaces(spark):
    r = random.Random(63)
    chinese = lambda n: "".join(chr(r.randint(0x4E00, 0x9FA5)) + ("。" if i % 9 == 8 else "") for i in range(n))
    passage, a, b = chinese(63), chinese(36), chinese(36)
    found = {x.doc_id: x.text for x in substring.report(spark.createDataFrame([(1, a + passage), (2, b + passage)], "doc_id long, text string")).collect()}
    assert found == {1: a + passage, 2: b}


def test_substring_keeps_a_repeating_first_occurrence(spark):
    found = {r.doc_id: r.text for r in substring.report(spark.createDataFrame([(1, "ha. " * 40), (2, "ha. ha. ha.")], "doc_id long, text string")).collect()}
    assert found == {1: "ha. ha. ha. ", 2: "ha. ha. ha."}


# ---- 10: chat formatting


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|turn|><|role|>", "\\", "\\\\<|end|>", "<", "|end|>", "[\\INST]", "", None, "<|join|>\n", "é中" * 50, "<<|end|>|end|>"]
    r = random.Random(4)
    data = [(c, i, r.choice(["user", "assistant", "assistant", "system", None, "<|end|>x"]), r.choice(hard), 0) for c in range(60) for i in range(r.randint(1, 9))]
    data += [(None, None, "user", "a", 0), (None, 1, "assistant", "b", 0)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, TURNS int")
    made = chat.format_conversations(turns)
    found = {x.conv_id: x for x in chat.digest(made).collect()}
    groups = defaultdict(list)
    for c, i, role, t, _ in data:
        groups[c].append((i if i is not None else -1, role or "", t or ""))
    for c, own in groups.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(found[c])[1:5] == want
    assert {x.conv_id: len(x.formatted) for x in made.collect()} == {c: x.formatted_chars for c, x in found.items()}
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_merges_adjacent_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns).first()
    assert row.formatted == "<|turn|>user<|role|>a<|end|><|turn|>assistant<|role|>b<|join|>c<|end|>"
    assert [s.text for s in row.segments if s.loss] == ["b", "c"] and "".join(s.text for s in row.segments) == row.formatted


def test_html_unescape_is_html5():
    assert html_lib.unescape("&ampx") == "&x" and pa.__version__
