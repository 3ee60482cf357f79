"""Audio features, Elkan clusters and fill-in-middle against plain versions of their contracts."""

import binascii
import hashlib
import io
import math
import random
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import audio, centroids, fim
from tests.llm.test_operators import SCHEMA, docs, empty, prose, rows, texts  # noqa: F401

# ---- 11: audio features


def plain_resample(x, up, down):
    """By definition: zeros between samples, the whole filter, then every down-th output; whole numbers."""
    taps = audio.low_pass(up, down)
    half = len(taps) // 2
    filled = np.zeros(len(x) * up, np.int64)
    filled[::up] = x
    full = np.convolve(filled, taps)
    return [int(full[m * down + half]) for m in range(-(-len(x) * up // down))]


@pytest.mark.parametrize("rate,to", [(16000, 10000), (16000, 8000), (8000, 16000), (9000, 6000)])
def test_resampling_is_the_definition(rate, to):
    r = np.random.default_rng(1)
    tool = audio.Resampler(rate, to)
    for n in (1, 2, 63, 64, 500):
        raw = r.integers(0, 256, n).astype(np.uint8)
        want = plain_resample(raw.astype(np.int64) - 128, tool.up, tool.down)
        out = tool(raw, 0, 10**6)
        assert (out * 128 * (1 << 14)).astype(np.int64).tolist() == want and len(out) == tool.length(n)
        for a, b in ((0, 3), (5, 40), (7, 8), (len(out) - 1, len(out) + 9)):
            assert tool(raw, a, b).tolist() == out[a:b].tolist()


def test_resampling_keeps_a_tone_and_drops_what_is_too_high():
    t = np.arange(16000) / 16000
    energy = lambda hz: float(np.mean(audio.Resampler(16000, 10000)((128 + 100 * np.sin(2 * np.pi * hz * t)).astype(np.uint8), 500, 9500) ** 2))
    assert abs(energy(1000) - energy(3000)) < 0.01 * energy(1000) and energy(7500) < 1e-3 * energy(1000)


def test_mel_frames_match_plain_sums():
    r = np.random.default_rng(2)
    raw = r.integers(0, 256, 4000).astype(np.uint8)
    mel, energy = audio.frames(raw, 16000)
    y = audio.Resampler(16000, 10000)(raw, 0, 10**6).astype(float)
    assert len(mel) == 1 + math.ceil((len(y) - 250) / 100)
    y = np.concatenate([y, np.zeros(300)])
    bank = audio.mel_bank(10000, 256, 32)
    for f in (0, 3, len(mel) - 1):
        frame = y[100 * f : 100 * f + 250]
        assert abs(energy[f] - 10 * math.log10(np.mean(frame**2) + 1e-8)) < 1e-3
        shaped = frame * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(250) + 0.5) / 250))
        k = np.arange(129)[:, None]
        power = np.abs((shaped * np.exp(-2j * np.pi * k * np.arange(250) / 256)).sum(axis=1)) ** 2
        assert np.abs(np.log10(power @ bank + 1e-8) - mel[f].astype(float)).max() < 0.01
    again, _ = audio.frames(raw, 16000, block=7)
    assert np.abs(again.astype(float) - mel.astype(float)).max() < 0.01
    assert (bank.max(axis=0) > 0).all() and bank.min() >= 0


def test_hysteresis_is_a_loop():
    r = np.random.default_rng(3)
    for _ in range(200):
        e = r.normal(0, 2, r.integers(1, 60)).astype(np.float32)
        middle, on, found = np.median(e), False, []
        for i, x in enumerate([*e, -np.inf]):
            if not on and x >= middle + 1.5:
                on, start = True, i
            elif on and x < middle - 1.5:
                on = False
                found.append([start, i])
        assert audio.sounding(e).tolist() == found


def test_media_round_trip_and_tensors(spark, docs, texts):  # noqa: F811
    media = audio.store(docs)
    assert {"TIE", "row", "key"} <= set(media.columns)
    out = {r.doc_id: r for r in audio.features(media.withColumn("kept", F.col("media"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        with wave.open(io.BytesIO(bytes(out[i].kept))) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16000, 1, 1) and w.readframes(10**9) == full
        patches, start, end = audio.tensors(bytes(out[i].tensors))
        assert patches.shape == (-(-out[i].n_frames // 16), 16, 32) and out[i].n_samples == len(full) and out[i].TIE == 1
        assert start.tolist() == [160_000 * p for p in range(len(patches))] and end[-1] <= len(full) * 62.5 and (end > start).all()
        assert all(0 <= s.start_us < s.end_us <= len(full) * 62.5 for s in out[i].segments)


def test_audio_report(spark, docs, texts, empty):  # noqa: F811
    found = {r.doc_id: r for r in audio.report(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), binascii.crc32(full[-64:]))
        assert r.media_bytes == len(full) + 44
    assert len({found[i].media_sha256 for i in (1, 2)}) == 1 and found[0].feature == found[4].feature and found[1].feature == found[2].feature
    many = spark.createDataFrame([(None, "x"), (3, prose(9, 3000)), (3, prose(9, 3000)), (4, prose(9, 3000))], "doc_id long, text string")
    same = audio.report(many).collect()
    assert len(same) == 4 and len({r.feature for r in same}) == 2
    assert audio.report(empty).count() == 0
    nulls = spark.createDataFrame([(1, None)], "id long, media binary")
    assert [(r.id, r.n_frames, r.segments) for r in audio.features(nulls).collect()] == [(1, None, [])]
    with pytest.raises(ValueError):
        audio.features(nulls.withColumn("rate", F.lit(1)))


def test_wav_reader_skips_and_refuses():
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setparams((1, 1, 8000, 0, "NONE", ""))
        w.writeframes(b"abcd")
    made = raw.getvalue()
    extra = made[:12] + b"LIST\x03\x00\x00\x00abc\x00" + made[12:]
    assert [(a, b.tobytes()) for a, b in map(audio.samples, (made, extra))] == [(8000, b"abcd")] * 2
    for bad in (b"", made[:20], made[:-1], made.replace(b"\x01\x00\x01\x00", b"\x01\x00\x02\x00")):
        with pytest.raises(ValueError):
            audio.samples(bad)


# ---- 12: clusters


def plain_clusters(vectors, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], r[1]))
    at = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(at)) for _, v in kept]
        if n < rounds:
            for j in range(len(at)):
                own = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == j]
                if own:
                    at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = [sum(d for d, m in near if m == j) for j in range(len(at))]
    return [(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, near, strict=True)]


def embedded(spark, data):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, vectors int, UPPER int")


def same_clusters(spark, data, **options):
    found = [tuple(r) for r in centroids.report(embedded(spark, data), **options).collect()]
    assert sorted(found, key=str) == sorted(plain_clusters(data, **options), key=str)
    return found


def test_clusters_match_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 40)
    r = random.Random(4)
    middles = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    data = [(i, [x + r.gauss(0, 0.3) for x in middles[i % 5]]) for i in range(300)]
    data += [(i, data[i][1]) for i in range(9)] + [(None, data[3][1]), (None, None), (400, None), (401, []), (402, [0.0] * 63), (403, [0.0] * 63 + [None]), (404, [math.nan] * 64), (405, [math.inf] * 64), (406, [0.0] * 64)]
    assert len(same_clusters(spark, data)) == 311


def test_clusters_of_ties_and_few_vectors(spark):
    grid = [(i, [0.0] * 62 + [(i % 4) / 1024, (i // 4) / 1024]) for i in range(16)]
    same_clusters(spark, grid)
    same_clusters(spark, [(i, [0.5] * 64) for i in range(20)])
    same_clusters(spark, grid[:3])
    same_clusters(spark, [(i, [r / 7, -r / 3]) for i, r in enumerate(random.Random(5).choices(range(9), k=50))], size=2, k=4, rounds=3)
    assert centroids.report(embedded(spark, [])).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.report(embedded(spark, [(1, [1e9] * 64)])).collect()


def test_bounds_skip_calculations_and_change_nothing():
    r = np.random.default_rng(6)
    for near in (1, 400):
        middles = r.integers(-3000, 3000, (6, 16))
        vectors = (middles[r.integers(0, 6, 3000)] + r.integers(-near, near + 1, (3000, 16))).astype(np.int32)
        at = vectors[:6].astype(np.int64)
        block, to = centroids.Block(vectors, 6), centroids.Centroids.of(at, at)
        for _ in range(12):
            block.assign(to)
            d = ((vectors[:, None, :].astype(np.int64) - to.at) ** 2).sum(axis=2)
            assert (block.nearest == d.argmin(axis=1)).all()
            own = np.sqrt(d[np.arange(3000), block.nearest].astype(np.longdouble))
            assert (block.upper >= own).all() and (block.lower <= np.sqrt(d.astype(np.longdouble))).all()
            sums = block.sums(6)
            moved = np.array([s[:-1] // s[-1] if s[-1] else c for s, c in zip(sums, to.at, strict=True)])
            to = centroids.Centroids.of(moved, to.at)
        assert block.calculated < 0.6 * 12 * 6 * 3000


# ---- 13: fill in the middle


def plain_fim(doc_id, text, seed=1):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    spm = h[3] % 100 < 20
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fim_matches_the_plain_version(spark, docs, texts, empty):  # noqa: F811
    r = random.Random(7)
    hard = ["a<P>b", "<S", "<<P", "P><", "<M>", "\n\n", "\x00", "中文 ab", "é" * 999, "a" * 5000, "😀x" * 300]
    own = [*texts, *hard, *("".join(r.choice(["ab", "Z", "<", ">", "P", "S", "M", "é", "中", "😀", " ", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(300))]
    table = spark.createDataFrame(rows(own), SCHEMA).unionAll(spark.createDataFrame([(None, "no id here", "en", "s", 1, "x", 1, "r", 7)] * 2, SCHEMA)).withColumn("n", F.lit("mine"))
    made = fim.transform(table)
    assert made.columns == [*table.columns, "n_1", "form", "prefix_chars", "middle_chars", "output"]
    found = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(own) + 2 and {x.form for x in found} == {"plain", "psm", "spm"}
    for x in found:
        assert (x.n_1, x.form, x.prefix_chars, x.middle_chars, x.output) == plain_fim(x.doc_id, x.text), x.text
        assert x.back == (x.text or "") and x.n == "mine" and x.TIE == 1
        assert x.doc_id is None or x.text == own[x.doc_id]
    digest = {x.doc_id: x for x in fim.report(docs).collect()}
    assert all(digest[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    assert fim.report(empty).count() == 0


@pytest.mark.parametrize("step,piece", [(1, 1), (3, 2), (4, 7), (7, 1 << 20), (512, 5)])
def test_checkpoints_find_every_unit(step, piece):
    r = random.Random(step * piece)
    for _ in range(60):
        t = "".join(r.choice(["a", "bc", "é", "中", "😀", " ", "1"]) for _ in range(r.randint(0, 40)))
        index = fim.Index(np.frombuffer(t.encode(), np.uint8), step, piece)
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        assert (index.units, index.points) == (len(units), len(t)) and len(index.unit) == -(-len(units) // step)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))
