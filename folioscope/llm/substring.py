"""Substring deduplication by hashing normalised units of text.

A unit is a stretch of a line that ends at ``. , ; : ! ?`` or the line break, so a passage inside a longer line is
found too. It is normalised to its words (lower case for A-Z, anything but letters and digits dropped) and hashed;
digests are grouped globally, and the earliest occurrence, by (document id, text hash, position), is the one that stays.
In each document, runs of later occurrences with MIN_WORDS words at least are cut. Shorter runs stay: chance repeats in
clean text do no harm.

A unit of one or two words tells too little alone, so it is looked up together with the units after it, up to three
words at least (at the end of a text with those before it); all units of a window that occurred before count as
repeated. A run ends at every unit of which no window occurred before, so words that are new always stay.

In scripts without spaces (Chinese, Japanese, Thai) each character is a word, and their full stops and commas end units.

Cut spans are kept as offsets (code points) into the original text; what is left is the text without them.

Digests are 64-bit. Partial minima run before the shuffle, and the join that marks later occurrences is one that Spark
can split for a frequent unit; only positions are gathered, those of one document at a time.

Defined results: a null text stays null; an empty one empty; rows equal in id and text are one document (each keeps or
loses the same spans); a null id ranks first; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import fresh
from folioscope.llm.hashing import ALNUM, U64, Words, lean, mixed, span_hashes, word_chunks

MIN_WORDS = 25
LEAST_UNIT = 3
#: Punctuation of scripts without spaces, as UTF-8.
_WIDE_ENDS = [c.encode() for c in "、。，．：；！？"]
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n"]] = True
_P, _P_INVERSE = U64(0xD6E8FEB86659FD93), U64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def split(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, with a word for each character of scripts without spaces; where units end."""
    data = words.data
    wide = (data >= 0xE3) & (data <= 0xE9)
    wide[:-1] |= (data[:-1] == 0xE0) & ((data[1:] == 0xB8) | (data[1:] == 0xB9))
    wide |= data == 0xEF
    at = np.flatnonzero(wide)
    ends = _ENDS[data]
    if not len(at):
        return words.start, words.end, ends
    gaps = np.zeros(len(data), bool)
    for a, b, c in _WIDE_ENDS:
        gaps[at[(data[at] == a) & (data[at + 1] == b) & (data[at + 2] == c)]] = True
    stops = np.flatnonzero(gaps)
    ends[stops] = True
    own = at[~gaps[at] & (data[at] != 0xEF)]
    inside = ALNUM[data]
    for k in range(3):
        inside[stops + k] = False
    cut = np.zeros(len(data) + 1, bool)  # a word may start here for another reason than white space before it
    cut[own] = cut[own + 3] = True
    cut[words.start] = True
    starts = inside & cut[:-1]
    starts[1:] |= inside[1:] & ~inside[:-1]
    start = np.flatnonzero(starts)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | starts[1:]
    return start, np.flatnonzero(last) + 1, ends


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit: its first word (and the number of words), text, the first unit of its window and the one after it,
    and the window's hash; and the first byte of each word."""
    start, end, stops = split(words)
    n = len(start)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(1, np.int64), none, none, none, np.zeros(0, U64), none
    own, opens = words.hash, words.first
    if start is not words.start:
        own, opens = span_hashes(words.data, start, end), np.searchsorted(start, words.offsets)
    ends = np.concatenate([[0], np.cumsum(stops)])
    new = np.ones(n, bool)
    new[1:] = ends[start[1:]] > ends[end[:-1]]
    new[opens[:-1][np.diff(opens) > 0]] = True
    first = np.append(np.flatnonzero(new), n)
    text = np.searchsorted(opens, first[:-1], "right") - 1
    low, high = np.searchsorted(first, opens[text]), np.searchsorted(first, opens[text + 1])  # units of the text
    after = np.minimum(np.searchsorted(first, first[:-1] + LEAST_UNIT), high)
    begin = np.arange(len(text))
    short = first[after] - first[:-1] < LEAST_UNIT
    begin[short] = np.maximum(np.searchsorted(first, first[high[short]] - LEAST_UNIT, "right") - 1, low[short])
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, p, U64)])) for p in (_P, _P_INVERSE))
        sums = np.concatenate([[U64(0)], np.cumsum(own * up[:n])])
        hashed = mixed((sums[first[after]] - sums[first[begin]]) * down[first[begin]])
    return first, text, begin, after, hashed, start


def unit_rows(docs: DataFrame) -> DataFrame:
    """id, tie, hashes (of windows with LEAST_UNIT words at least) and places: 4 * the unit's index in its document + the
    window's number of units, which is 3 at most."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                hashes, places = [], []
                for _, _, words in word_chunks(part.column(2), ALNUM):
                    first, text, begin, after, hashed, _ = units(words)
                    bounds = np.searchsorted(text, np.arange(len(words) + 1))
                    long = first[after] - first[begin] >= LEAST_UNIT
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                        keep = np.flatnonzero(long[a:b])
                        hashes.append(hashed[a:b][keep].view(np.int64))
                        places.append((4 * keep + (after - begin)[a:b][keep]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["id", "tie", "hashes", "places"])

    return docs.mapInArrow(lean(run), "id long, tie long, hashes array<long>, places array<int>")


def later_occurrences(docs: DataFrame) -> DataFrame:
    """id, tie and the sorted indices of the units whose windows occurred before. docs: id, tie, text.

    A window that overlaps the first occurrence in its own document is none.
    """
    every = unit_rows(docs).select("id", "tie", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("id", "tie", F.col("x.hashes").alias("h"), F.col("x.places").alias("place"))
    firsts = every.groupBy("h").agg(F.min(F.struct("id", "tie", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tie") == F.col("first.tie"))
    unit = F.shiftright("place", 2)
    later = every.join(firsts, "h").where(~(same & (unit - F.shiftright("first.place", 2) < F.col("place").bitwiseAND(3))))
    return later.groupBy("id", "tie").agg(F.array_sort(F.collect_set(unit)).alias("later"))


def cut_spans(text: str, later: list[int], min_words: int) -> list[tuple[int, int]]:
    """Byte spans of the text's runs of later units."""
    spans: list[tuple[int, int]] = []
    for _, _, words in word_chunks(pa.array([text], pa.string()), ALNUM):
        first, _, begin, after, _, start = units(words)
        size = np.diff(first)
        depth = np.zeros(len(size) + 1, np.int64)
        np.add.at(depth, begin[later], 1)
        np.add.at(depth, after[later], -1)
        marked = np.flatnonzero(np.cumsum(depth)[:-1] > 0)
        breaks = np.flatnonzero(np.diff(marked) > 1) + 1
        for run in np.split(marked, breaks):
            if len(run) and first[run[-1] + 1] - first[run[0]] >= min_words:
                stop = int(start[first[run[-1] + 1]]) if run[-1] + 1 < len(size) else len(words.data)
                spans.append((int(start[first[run[0]]]), stop))
    return spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, removed: str = "removed") -> DataFrame:
    """docs with the text without later occurrences, and their spans in the original text in a new column."""
    names = docs.columns
    spans_name = fresh(names, removed)
    inner = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    later = later_occurrences(inner.select("id", "tie", "text"))
    joined = inner.join(later, inner["id"].eqNullSafe(later["id"]) & (inner["tie"] == later["tie"]), "left").select(inner["row"], inner["text"], F.coalesce("later", F.array().cast("array<int>")).alias("later"))
    schema = T.StructType([joined.schema["row"], T.StructField("text", T.StringType()), T.StructField("spans", SPANS)])

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, spans = [], []
                for t, later in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found = cut_spans(t, later, min_words) if t and later else []
                    if found:
                        raw = t.encode()
                        left, own, gone, chars = [], [], 0, 0
                        for a, b in found:
                            left.append(raw[gone:a])
                            start = chars + len(left[-1].decode())
                            chars = start + len(raw[a:b].decode())
                            own.append({"start": start, "end": chars})
                            gone = b
                        left.append(raw[gone:])
                        t, found = b"".join(left).decode(), own
                    texts.append(t)
                    spans.append(found)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["row", "text", "spans"])

    done = joined.mapInArrow(lean(run), schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names], F.col("spans").alias(spans_name))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, the text that is left, its length and what was removed, a row for each document."""
    found = deduplicate(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), **options)
    gone = F.aggregate(F.transform("removed", lambda s: s["end"] - s["start"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), gone.alias("n_removed"), "removed")


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with their texts cut, in their own columns; documents of which no word is left go."""
    out = deduplicate(docs, doc_id, text)
    spans = [c for c in out.columns if c not in docs.columns][0]
    out = out.where((F.size(spans) == 0) | F.col(f"`{text}`").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F、。，．：；！？]")).drop(spans)
    if n_chars and n_chars in docs.columns:
        out = out.withColumn(n_chars, F.char_length(F.col(f"`{text}`")).cast(docs.schema[n_chars].dataType))
    return out
