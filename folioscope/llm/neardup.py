"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, connected components.

SuperMinHash (Ertl, 2017): each element ranks the slots of the signature by a permutation of its own and offers slot
p(j) the value j + r, j = 0, 1, ...; a slot keeps the smallest. Once every slot is below j + 1 no further rank can
matter, so a text with many shingles ends after a few ranks. Ranks of one element are correlated (a permutation), which
lowers the variance against independent hashes. All texts of a chunk are processed together, rank by rank, in numpy.

The way to components:

1. documents with equal shingle sets are one class, represented by the smallest id (partial sums, no pairs);
2. representatives share a bucket where a band of ROWS slots agrees; each is paired with one head, the bucket's smallest
   document that it meets most often, and the pair is confirmed on the full sets: a pair a document, whatever the group;
3. components are contracted; buckets that still hold several components compare all their documents of different
   components, in tiles of TILE documents, so no task gets a whole hot bucket; pairs are compared on the full sets
   inside the task and are never rows, and a task returns only links that join components;
4. the confirmed links of both rounds give the components.

A pair with similarity 0.75 shares none of the 32 bands of 4 with probability 5e-6, and its estimate falls below
MIN_AGREE of 128 slots with probability below 4e-5.

Defined results: lower case is for A-Z only; a text with fewer than five words is one shingle; a null text or one
without words has an empty set and is linked with nothing; rows with one id are one node, and each gets its row; a null
id is its own class (component null, kept); extra columns pass through ``keep_one``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import only, text_or_empty, written
from folioscope.llm.components import connected
from folioscope.llm.hashing import lean, mixed, SPACED, U64, windows, word_chunks, Words

SHINGLE = 5
SLOTS, BANDS = 128, 32
ROWS = SLOTS // BANDS
PERCENT = 75
MIN_AGREE = 76
TILE = 1500
_C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted, as two arrays."""
    counts = np.diff(words.first)
    grams = windows(words.hash, SHINGLE)
    text = np.repeat(np.arange(len(words)), counts)
    whole = text[: len(grams)] == text[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    texts, hashes = [text[: len(grams)][whole]], [grams[whole]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            own = windows(words.hash, n)[words.first[short]]
            texts.append(short)
            hashes.append(mixed(own ^ U64(n)))
    text, hashed = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    return text[new], hashed[new]


def signatures(text: np.ndarray, hashed: np.ndarray, n_texts: int) -> np.ndarray:
    """SuperMinHash values, SLOTS for each text, as numbers rank * 2**56 + fraction."""
    best = np.full(n_texts * SLOTS, np.iinfo(np.uint64).max, U64)
    m = U64(SLOTS - 1)
    with np.errstate(over="ignore"):
        key = mixed(hashed * _C[0])
        live_text, live, live_key = text, hashed, key
        for j in range(SLOTS):
            if not len(live):
                break
            value = (U64(j) << U64(56)) | (mixed(live + _C[1] * U64(j + 1)) >> U64(8))
            slot = (U64(j) ^ live_key) & m  # a bijection of j for each element
            slot = slot * ((live_key >> U64(7)) | U64(1)) & m
            slot ^= slot >> U64(4)
            slot = (slot + (live_key >> U64(14))) & m
            slot = slot * ((live_key >> U64(21)) | U64(1)) & m
            slot ^= slot >> U64(3)
            slot ^= (live_key >> U64(28)) & m
            np.minimum.at(best, live_text * SLOTS + slot.astype(np.int64), value)
            open_texts = best.reshape(-1, SLOTS).max(axis=1) >= U64(j + 1) << U64(56)
            stay = open_texts[live_text]
            if not stay.all():
                live_text, live, live_key = live_text[stay], live[stay], live_key[stay]
    return best.reshape(-1, SLOTS)


def features(column: pa.Array):
    """Lists n_shingles, set_a, set_b, bands and short signature for the texts of a column."""
    out: list[list] = [[], [], [], [], []]
    for _, _, words in word_chunks(column, SPACED):
        n = len(words)
        text, hashed = shingles(words)
        count = np.bincount(text, minlength=n)
        first = np.searchsorted(text, np.arange(n))
        sums = np.zeros((2, n), U64)
        filled = np.flatnonzero(count)
        if len(filled):
            with np.errstate(over="ignore"):
                sums[0, filled] = np.add.reduceat(mixed(hashed ^ _C[2]), first[filled])
                sums[1, filled] = np.add.reduceat(mixed(hashed * _C[3]), first[filled])
        best = signatures(text, hashed, n)
        with np.errstate(over="ignore"):
            bands = np.zeros((n, BANDS), U64)
            for r in range(ROWS):
                bands = mixed(bands * _C[0] + best[:, r::ROWS])
            bands = mixed(bands + np.arange(BANDS, dtype=U64) * _C[1])
        short = ((best >> U64(8)) & U64(255)).astype(np.uint8)
        out[0] += count.tolist()
        out[1] += sums[0].view(np.int64).tolist()
        out[2] += sums[1].view(np.int64).tolist()
        out[3] += [x if c else [] for x, c in zip(bands.view(np.int64).tolist(), count.tolist(), strict=True)]
        out[4] += [x.tobytes() for x in short]
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """docs: id, tie (hash of the text), text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, a, b, bands, short = features(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                    names=["id", "tie", "n_shingles", "set_a", "set_b", "bands", "short"],
                )

    return docs.mapInArrow(lean(run), "id long, tie long, n_shingles long, set_a long, set_b long, bands array<long>, short binary")


def agreeing(pairs: DataFrame, representatives: DataFrame) -> DataFrame:
    """The pairs (u, u_tie, v, v_tie) whose signatures agree in MIN_AGREE slots at least."""
    for side in "uv":
        own = representatives.select(F.col("id").alias(side), F.col("tie").alias(f"{side}_tie"), F.col("short").alias(f"{side}_short"))
        pairs = pairs.join(own, [side, f"{side}_tie"])

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(f"{s}_short")).to_pylist()), np.uint8).reshape(-1, SLOTS) for s in "uv")
            keep = pa.array((a == b).sum(axis=1) >= MIN_AGREE) if len(a) else pa.array([], pa.bool_())
            yield batch.select(["u", "u_tie", "v", "v_tie"]).filter(keep)

    return pairs.mapInArrow(lean(run), "u long, u_tie long, v long, v_tie long")


#: Documents (16 bytes each) up to which a list of them is broadcast; beyond it Spark joins by shuffle.
BROADCAST_IDS = 2_000_000


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, tie and text of the documents in ids (id, tie), each once."""
    ids = written(ids.distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, ["id", "tie"], "left_semi").dropDuplicates(["id", "tie"])


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The links u, v among the pairs: those with 100 * intersection >= percent * union on full sets."""
    ids = pairs.select(F.col("u").alias("id"), F.col("u_tie").alias("tie")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v_tie").alias("tie")))
    texts = written(texts_of(docs, ids))
    for side in "uv":
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("tie").alias(f"{side}_tie"), F.col("text").alias(f"{side}_text")), [side, f"{side}_tie"])

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = []
            for i in range(len(u)):
                key = (u[i], batch.column("u_tie")[i].as_py())
                if last[0] != key:
                    last = (key, full_set(batch.column("u_text")[i].as_py()))
                a, b = last[1], full_set(batch.column("v_text")[i].as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("u", "u_tie", "v", "v_tie", "u_text", "v_text").mapInArrow(lean(run), "u long, v long")


def full_set(text: str) -> np.ndarray:
    sets = [shingles(words)[1] for _, _, words in word_chunks(pa.array([text], pa.string()), SPACED)]
    return sets[0] if sets else np.zeros(0, U64)


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Each document with one head: of the smallest ones of its buckets, the one it shares most buckets with.

    buckets: key, id, tie. At most a pair a document, however large the buckets.
    """
    heads = buckets.groupBy("key").agg(F.min(F.struct("id", "tie")).alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    met = buckets.join(heads, "key").where(F.col("id") != F.col("head.id")).groupBy("id", "tie", "head").agg(F.count("*").alias("n"))
    best = met.groupBy("id", "tie").agg(F.max_by("head", F.struct("n", -F.col("head.id"))).alias("head"))
    return best.select(F.col("head.id").alias("u"), F.col("head.tie").alias("u_tie"), F.col("id").alias("v"), F.col("tie").alias("v_tie"))


def tiled(buckets: DataFrame, components: DataFrame, representatives: DataFrame) -> DataFrame:
    """The documents of buckets with several components, dealt out to pairs of tiles (key, p, q).

    The largest component of a bucket is side 0, the rest is side 1; each side has tiles of about TILE documents. Tiles
    of side 1 meet all tiles; two tiles of side 0 never meet.
    """
    placed = buckets.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed_up = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > F.col("top.n"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    mixed_up = mixed_up.select("key", F.col("top.component").alias("largest"), tiles(F.col("top.n")).alias("tiles_0"), tiles(F.col("all") - F.col("top.n")).alias("tiles_1"))
    own = placed.join(mixed_up, "key").withColumn("side", (F.col("component") != F.col("largest")).cast("int"))
    own = own.withColumn("tile", F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("side") == 0, F.col("tiles_0")).otherwise(F.col("tiles_1"))).cast("int"))
    met = lambda side, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.lit(side).alias("s"), k.alias("k")))
    partners = F.when(F.col("side") == 0, met(1, F.col("tiles_1"))).otherwise(F.concat(met(0, F.col("tiles_0")), met(1, F.col("tiles_1"))))
    dealt = own.select("key", "id", "tie", "component", F.struct(F.col("side").alias("s"), F.col("tile").alias("k")).alias("me"), F.explode(partners).alias("other"))
    return dealt.select("key", "id", "tie", "component", F.least("me", "other").alias("p"), F.greatest("me", "other").alias("q"), (F.col("me") != F.least("me", "other")).alias("second"))


def _candidates(group: pa.Table, short: np.ndarray, bands: np.ndarray):
    """(a document, those to compare it with) in a pair of tiles: of other components, agreeing, first met here."""
    ids, comp = (group.column(c).to_numpy() for c in ("id", "component"))
    second, key = group.column("second").to_numpy(), group.column("key")[0].as_py()
    left = np.flatnonzero(~second)
    right = np.flatnonzero(second) if second.any() else left
    for i in left:
        rest = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (right is not left))]
        rest = rest[(short[rest] == short[i]).sum(axis=1) >= MIN_AGREE]
        if len(rest):
            same = bands[rest] == bands[i]
            rest = rest[bands[rest, same.argmax(axis=1)] == key]
            if len(rest):
                yield i, rest


def _signs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(-1, SLOTS), group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)


def crossing_links(buckets: DataFrame, components: DataFrame, representatives: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different components that share a bucket, enough to connect all that are linked.

    First the signatures alone tell which documents of a pair of tiles have a candidate there; then the texts of just
    these come, and sets are compared inside the task: no pair is ever a row. Links that join what the task has joined
    already are left out, so a task returns fewer links than it has documents.
    """
    signed = representatives.select("id", "tie", "short", "bands")
    dealt = tiled(buckets, components, representatives).join(signed, ["id", "tie"])
    names = ["key", "p", "q", "id", "tie", "component", "second"]

    def worth(group: pa.Table) -> pa.Table:
        keep = np.zeros(group.num_rows, bool)
        for i, rest in _candidates(group, *_signs(group)):
            keep[i] = True
            keep[rest] = True
        return group.select(names).filter(pa.array(keep))

    place = "struct<s:int,k:int>"
    left = written(dealt.groupBy("key", "p", "q").applyInArrow(worth, f"key long, p {place}, q {place}, id long, tie long, component long, second boolean"))
    if left.isEmpty():
        return docs.sparkSession.createDataFrame([], "u long, v long")
    texts = texts_of(docs, left.select("id", "tie"))
    full = left.join(signed, ["id", "tie"]).join(texts, ["id", "tie"])

    def compare(group: pa.Table) -> pa.Table:
        ids, comp = group.column("id").to_numpy(), group.column("component").to_pylist()
        sets = [full_set(t) for t in group.column("text").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        _, dense = np.unique(np.concatenate(sets), return_inverse=True)
        marks = np.zeros(dense.max() + 1 if len(dense) else 1, bool)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        u, v = [], []
        for i, rest in _candidates(group, *_signs(group)):
            rest = [j for j in rest.tolist() if root(comp[j]) != root(comp[i])]
            if not rest:
                continue
            marks[dense[ends[i] : ends[i + 1]]] = True
            for j in rest:
                both = int(marks[dense[ends[j] : ends[j + 1]]].sum())
                if 100 * both >= percent * (sizes[i] + sizes[j] - both) and root(comp[j]) != root(comp[i]):
                    parent[root(comp[j])] = root(comp[i])
                    u.append(ids[i])
                    v.append(ids[j])
            marks[dense[ends[i] : ends[i + 1]]] = False
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return full.groupBy("key", "p", "q").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs."""
    own = only(docs, id=doc_id, text=text).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("tie"), text_or_empty("text").alias("text"))
    made = written(with_features(own))
    classes = written(
        made.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min(F.struct("id", "tie")).alias("head"), F.min_by(F.struct("bands", "short"), F.struct("id", "tie")).alias("of"))
        .select("set_a", "set_b", "n_shingles", F.col("head.id").alias("id"), F.col("head.tie").alias("tie"), F.col("of.bands").alias("bands"), F.col("of.short").alias("short"))
    )
    buckets = classes.select("id", "tie", F.explode("bands").alias("key"))
    same_set = made.join(classes.select("set_a", "set_b", "n_shingles", F.col("id").alias("v")), ["set_a", "set_b", "n_shingles"]).select(F.col("id").alias("u"), "v").where("u <> v")
    stars = written(confirmed(written(agreeing(star_pairs(buckets), classes)), own, percent))
    first = connected(stars)
    links = stars.unionByName(same_set).unionByName(written(crossing_links(buckets, first, classes, own, percent)))
    final = connected(links)
    out = made.select(F.col("id").alias("doc_id"), "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the smallest id; all columns stay."""
    found = near_duplicates(docs, doc_id, text, percent).where("NOT kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(found, docs[f"`{doc_id}`"] == found["dropped_id"], "left_anti")
