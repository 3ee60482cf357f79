"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every item gives its windows of 10 consecutive words; a shorter item is one window. Patterns of one length form a
search table. The block (the last two words up to a position) indexes a *shift table*: how far the nearest pattern
end may lie from here. Positions with a shift above 0 end no pattern and are skipped; for the others the hash of a
longer suffix selects the *bucket* of patterns, and a direct comparison of the words' bytes confirms each occurrence.
The shift table is read for all positions of a batch of texts at once, in numpy.

Items are searched in blocks of about BLOCK_BYTES of text. A benchmark of one block is sent to the executors; a larger
one is written to the shared folder by block, and each task reads the one it needs, so neither the driver nor a worker
ever holds more than a block (or the longest item, if that is longer). Each block is a pass over the documents, and
their spans are merged per document.

Defined results: a null text, of a document or an item, has no words; a null item id is left out of the list of
items but its windows still hit; each row of the documents is searched on its own, however many blocks there are (with
more than one, rows get a key in a table in the shared folder first); items with the same text are all listed; an empty benchmark hits nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import filesystem, only, shared_dir, written
from folioscope.llm.hashing import ALNUM, lean, LOWER, mixed, U64, utf8, windows, word_chunks, Words

WINDOW = 10
#: Text of the items that are searched in one pass.
BLOCK_BYTES = 32 << 20
SUFFIX = 5


class Table:
    """Shift table, buckets and patterns of one length."""

    def __init__(self, length: int, patterns: np.ndarray, texts: list[bytes], items: list[list[int]]):
        """patterns: a row of word hashes for each; texts: their words joined by a space; items: positions in the list of items."""
        self.length, self.block, self.suffix = length, min(2, length), min(SUFFIX, length)
        key = windows_of_rows(patterns, self.suffix)
        order = np.argsort(key, kind="stable")
        self.patterns, self.key = patterns[order], key[order]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]
        bits = max(12, int(len(patterns) * length).bit_length() + 2)
        self.mask = U64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.block + 1, np.uint8 if length < 250 else np.int32)
        for at in range(self.block - 1, length):
            block = windows_of_rows(patterns[:, at - self.block + 1 : at + 1], self.block) & self.mask
            np.minimum.at(self.shift, block, self.shift.dtype.type(length - 1 - at))

    def find(self, words: Words) -> Iterator[tuple[int, int]]:
        """(index of the first word, pattern) of each occurrence; those across two texts too."""
        hashes = words.hash
        if len(hashes) < self.length:
            return
        blocks = windows(hashes[self.length - self.block :], self.block)  # of the windows that start at 0, 1, ...
        start = np.flatnonzero(self.shift[blocks & self.mask] == 0)
        if not len(start):
            return
        key = windows_of_rows(hashes[start[:, None] + np.arange(self.length - self.suffix, self.length)], self.suffix)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        for depth in range(int((high - low).max(initial=0))):
            live = np.flatnonzero(low + depth < high)
            which, at = low[live] + depth, start[live]
            same = (hashes[at[:, None] + np.arange(self.length)] == self.patterns[which]).all(axis=1)
            for a, p in zip(at[same].tolist(), which[same].tolist(), strict=True):
                if b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[a : a + self.length], words.end[a : a + self.length], strict=True)) == self.texts[p]:
                    yield a, p


def windows_of_rows(rows: np.ndarray, size: int) -> np.ndarray:
    """Hash of the last so many words of each row, as windows() has it."""
    with np.errstate(over="ignore"):
        out = rows[:, -size].copy()
        for k in range(-size + 1, 0):
            out = out * U64(0x9E3779B97F4A7C15) + rows[:, k]
        return mixed(out)


def tables(texts: list[str | None]) -> list[Table]:
    found: dict[int, dict[bytes, list]] = {}
    for i, text in enumerate(texts):
        data, offsets = utf8(pa.array([text], pa.string()))
        words = Words(LOWER[data], offsets, ALNUM)
        n = len(words.hash)
        size = min(n, WINDOW)
        for a in range(n - size + 1 if n else 0):
            raw = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[a : a + size], words.end[a : a + size], strict=True))
            entry = found.setdefault(size, {}).setdefault(raw, [words.hash[a : a + size], []])
            if not entry[1] or entry[1][-1] != i:
                entry[1].append(i)
    return [Table(size, np.array([x[0] for x in own.values()], U64), list(own), [x[1] for x in own.values()]) for size, own in found.items()]


def search(column: pa.Array, own: list[Table]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
    """(words, merged spans of hit words, items) of each text."""
    for row, to, words in word_chunks(column, ALNUM):
        hits = []
        for table in own:
            for a, p in table.find(words):
                text = int(np.searchsorted(words.first, a, "right")) - 1
                if a + table.length <= words.first[text + 1]:
                    hits.append((text, a - int(words.first[text]), table.length, table.items[p]))
        hits.sort(key=lambda x: x[:2])
        at = 0
        for text in range(to - row):
            spans: list[tuple[int, int]] = []
            items: set[int] = set()
            while at < len(hits) and hits[at][0] == text:
                _, a, size, which = hits[at]
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], a + size))
                else:
                    spans.append((a, a + size))
                items.update(which)
                at += 1
            yield int(words.first[text + 1] - words.first[text]), spans, items


SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))
ARROW_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def _scan(docs: DataFrame, items) -> DataFrame:
    """One pass: docs (row struct, text) against the block of items that items() gives on the executor."""
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("spans", SPAN), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        names, texts = items()
        own = tables(texts)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = list(search(part.column(part.num_columns - 1), own))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1],
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([[{"first": a, "after": b} for a, b in x[1]] for x in found], ARROW_SPAN),
                        pa.array([sorted({names[i] for i in x[2] if names[i] is not None}) for x in found], pa.list_(pa.string())),
                    ],
                    names=schema.fieldNames(),
                )

    return docs.mapInArrow(lean(run), schema)


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list:
    """For each block of the items a function that gives, on an executor, their ids as text and their texts."""
    rows = only(benchmark, item=item_id, text=text).where(F.col("text").isNotNull()).select(F.col("item").cast("string").alias("item"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        own = rows.collect()
        sent = benchmark.sparkSession.sparkContext.broadcast(([x[0] for x in own], [x[1] for x in own]))
        return [lambda: sent.value]
    folder = shared_dir(benchmark.sparkSession)
    rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).write.partitionBy("block").parquet(folder)

    def reader(k: int):
        def read():
            import pyarrow.parquet as pq

            store, path = filesystem(folder)
            place = f"{path}/block={k}"
            files = [f.path for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.path.endswith(".parquet")]
            read = [pq.read_table(store.open_input_file(f), columns=["item", "text"]) for f in sorted(files)]
            return [x for t in read for x in t.column("item").to_pylist()], [x for t in read for x in t.column("text").to_pylist()]

        return read

    return [reader(k) for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs as struct row, n_words, spans (of words, merged) and items (as text, sorted)."""
    keep = docs.columns if keep is None else keep
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        return _scan(inner, blocks[0])
    keyed = written(inner.select("row", F.monotonically_increasing_id().alias("key"), "text"))
    every = functools.reduce(DataFrame.unionByName, [_scan(keyed.select("key", "text"), b) for b in blocks])
    spans, items = F.sort_array(F.flatten(F.collect_list("spans"))), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items"))))
    grouped = every.groupBy("key").agg(F.first("n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))
    return keyed.select("row", "key").join(grouped, "key").select("row", "n_words", "spans", "items")


def hit_words(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by their start and may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["after"] - F.greatest(s["first"], a["to"]))).alias("n"), F.greatest(a["to"], s["after"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **names) -> DataFrame:
    """The contract's columns, a row for each document."""
    found = scan(docs, benchmark, keep=[doc_id], **names)
    return found.select(
        F.col("row").getField(doc_id).alias("doc_id"),
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without an occurrence; all columns stay."""
    return scan(docs, benchmark, **names).where(F.size("spans") == 0).select("row.*")
