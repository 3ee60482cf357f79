"""Toxicity scores against a plain version of the model, and texts out of the ordinary."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import toxicity
from folioscope.llm.hashing import ALNUM, word_chunks
from tests.llm.test_operators import prose

MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_bag(word):
    """Buckets of a word: its own, and that of each 3 to 5 bytes of it with marks around it."""
    raw = [1, *word, 2]
    power = 0x9E3779B97F4A7C15
    whole, p = 0, 1
    for c in word:
        whole, p = (whole + (c + 1) * p) & MASK, p * power & MASK
    out = [mix(whole)]
    for n in (3, 4, 5):
        for i in range(len(raw) - n + 1):
            h = n
            for c in raw[i : i + n]:
                h = (h * 0x100000001B3 + c) & MASK
            out.append(mix(h))
    return [x & (toxicity.BUCKETS - 1) for x in out]


def plain_score(text, table, bias, prior):
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower().decode())]
    best = None
    for i in range(0, len(words), 12):
        bag = [b for w in words[i : i + 12] for b in plain_bag(w)]
        value = sum(float(table[b]) for b in bag) / len(bag) + bias
        best = value if best is None else max(best, value)
    return prior if best is None else 1 / (1 + math.exp(-max(-30.0, min(30.0, best))))


def test_scores_are_the_plain_version():
    r = np.random.default_rng(1)
    table = r.normal(0, 3, toxicity.BUCKETS).astype(np.float32)
    tool = toxicity.Model(table, -0.5, 0.25)
    say = random.Random(2)
    texts = ["", " \n", "a", "Ab ÉÉ", "ß", "x" * 500, "中文 字", prose(3, 12), prose(4, 13), prose(5, 600), "!!", "A a A", *(" ".join(say.choice(["foo", "Bar", "é", "1"]) for _ in range(n)) for n in range(1, 40))]
    found = tool.score(pa.array([*texts, None], pa.string()))
    assert np.abs(found - [plain_score(t, table, -0.5, 0.25) for t in [*texts, ""]]).max() < 1e-5


def test_bags_are_subwords():
    for _, _, words in word_chunks(pa.array(["hello wörld", "a"], pa.string()), ALNUM):
        buckets, bounds = toxicity.subwords(words, np.arange(3))
        for i, w in enumerate(("hello", "wörld", "a")):
            assert sorted(buckets[bounds[i] : bounds[i + 1]].tolist()) == sorted(plain_bag(w.encode()))


def test_long_ties_and_repeated_rows(spark):
    """Equal texts score alike wherever they stand; one toxic word in a very long text counts."""
    r = random.Random(5)
    data, labels = [], []
    for i in range(300):
        w = prose(2000 + i, 60).split()
        if i % 3 == 0:
            w[r.randrange(60)] = "wretchedfool"
        data.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    long = prose(9, 20_000).split()
    data += [(900, " ".join(long)), (901, " ".join([*long[:9000], "wretchedfool", *long[9000:]])), (902, data[0][1]), (902, data[0][1]), (903, data[0][1].upper())]
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels + labels[:50], "doc_id long, toxic int")
    found = [(x.doc_id, x.score) for x in toxicity.fit_and_score(docs, marks).collect()]
    assert len(found) == len(data)
    of = dict(found)
    assert of[900] + 0.2 < of[901] and {s for i, s in found if i == 902} == {of[0]} == {of[903]}
    assert [of[i] for i in range(300)] == [x.score for x in toxicity.fit_and_score(docs, marks).orderBy("doc_id").collect()][:300]


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_only(spark, label):
    docs = spark.createDataFrame([(i, prose(i, 20)) for i in range(20)], "doc_id long, text string")
    out = toxicity.fit_and_score(docs, docs.selectExpr("doc_id", f"{label} AS toxic")).collect()
    assert {x.predicted for x in out} == {label}
