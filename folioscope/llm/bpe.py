"""Byte-level BPE: encoding by folded ranked merges with Spark expressions, decoding by joined byte strings.

The rank file becomes a literal rank map: for each pair of tokens whose bytes together are a token, the rank of that
token (which is its id). It is laid out as a displaced table, so a pair costs three array reads: the left id gives an
offset, the right id the slot, and the slot tells whose it is. A token is written as one character whose code point
follows its id, so the state of a word is two strings, the tokens and the ranks of the pairs that start at each, and a
merge overlays a character or two. A higher-order fold over the word's bytes merges the leftmost pair of lowest rank at
every step and looks up the two new neighbours only.

Every distinct word is merged once, in one of two places:

* the HOT words that most of about SAMPLE documents (chosen by a hash of the text) hold are numbered by frequency and
  merged first; their table, bounded by HOT, lies in the shared folder, where workers read it;
* a text becomes a line: a character for each numbered word and a mark for any other, and these words after it. They are
  exploded, made distinct over all documents by partial aggregation, folded once each and joined back by word, then by
  document. The exchange that deals the lines out is read by both sides. A word is joined as often as documents hold
  it, not as often as it stands in them.

HOT and SAMPLE change where a word is merged, never its ids: workers find a word's number by a hash and compare its bytes.
Workers put the ids of a line together and decode
them by joining the bytes of each. A word of more than LONG_WORD bytes isn't joined; the worker takes the same merges from a heap, as the fold's cost grows with the square of a word.

Texts are split by the vocabulary's pattern, with ``\\s`` and its kin in their Unicode sense. The JVM's letter and number
classes are those of its Unicode version; a letter assigned later would split differently.

Defined results: a null text is empty: no ids, the digests of nothing; rows with one id are encoded each; extra columns
pass through ``encode``; an empty table gives no rows. A text's ids and its distinct words must fit into a row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import filesystem, fresh, only, shared_dir, text_or_empty, written
from folioscope.llm.hashing import CHUNK, lean, span_hashes, spread, utf8

#: Words that are numbered and encoded before all others.
HOT = 350_000
#: Documents, about, whose words are counted to choose them.
SAMPLE = 60_000
#: Bytes beyond which a word is merged by a heap.
LONG_WORD = 256
#: A number is written as the character with that code point, past MARK and the surrogates.
MARK, SURROGATES, N_SURROGATES = "\x00", 0xD800, 0x800
MOST = 0x110000 - N_SURROGATES - 2
#: Bits of the key that words are joined back by.
KEY_BITS = 40
#: Texts that a worker puts together at once.
BATCH = 200
NO_PAIR = "\U0010ffff"
NONE = 2**31 - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def char(i: int) -> str:
    """The character that stands for a number below MOST."""
    return chr(i + 1 if i + 1 < SURROGATES else i + 1 + N_SURROGATES)


def line_of(numbers: np.ndarray) -> str:
    """A character for each number, MARK for those below 0."""
    return (numbers + 1 + N_SURROGATES * (numbers + 1 >= SURROGATES)).astype("<u4").tobytes().decode("utf-32-le")


def numbers_of(line: str) -> np.ndarray:
    points = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.int64)
    return points - 1 - N_SURROGATES * (points >= SURROGATES)


def merge_all(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The fold in plain Python, for words known on the driver."""
    ids = list(ids)
    ranks = [pairs.get(p, NONE) for p in zip(ids, ids[1:], strict=False)]
    while ranks and (best := min(ranks)) != NONE:
        i = ranks.index(best)
        ids[i : i + 2] = [best]
        del ranks[i]
        if i:
            ranks[i - 1] = pairs.get((ids[i - 1], best), NONE)
        if i < len(ranks):
            ranks[i] = pairs.get((best, ids[i + 1]), NONE)
    return ids


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps: pairs wait in a heap by rank and place; those of merged tokens are stale."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = [True] * n

    def push(i: int) -> None:
        if i >= 0 and end[i] < n and (r := ranks.get(word[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, to = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != to:
            continue
        live[end[i]] = False
        end[i] = to
        if to < n:
            before[to] = i
        push(i)
        push(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


@dataclass
class RankMap:
    """The rank map as arrays, whose places are code points of tokens; plans take it as a literal."""

    byte_chars: list[str]
    offset: np.ndarray
    owner: np.ndarray
    merged: list[str]
    tokens: list[bytes]  # the bytes of each id
    whole: list[tuple[bytes, int]]  # tokens that merging alone doesn't reach, but the encoder takes as they are

    @classmethod
    def read(cls, path: str) -> "RankMap":
        return cls.of(read_ranks(path))

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> "RankMap":
        pairs = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        point = {r: ord(char(r)) for r in ranks.values()}
        size = max(point.values()) + 1
        rows: dict[int, list[int]] = {}
        for left, right in pairs:
            rows.setdefault(left, []).append(right)
        slots = 1 << max(10, (2 * len(pairs)).bit_length())
        taken, offset = np.zeros(slots + size, bool), np.zeros(size, np.int64)
        owner, merged = np.full(slots + size, -1, np.int64), [""] * (slots + size)
        rng = np.random.default_rng(0)
        for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
            own = np.array([point[r] for r in rows[left]])
            while True:
                at = int(rng.integers(0, slots))
                if not taken[at + own].any():
                    break
            taken[at + own], offset[point[left]], owner[at + own] = True, at, point[left]
            for r in rows[left]:
                merged[at + point[r]] = char(pairs[left, r])
        token = {r: t for t, r in ranks.items()}
        return cls(
            [char(ranks[bytes([i])]) for i in range(256)],
            offset,
            owner,
            merged,
            [token.get(i, b"") for i in range(max(ranks.values()) + 1)],
            [(t, r) for t, r in ranks.items() if len(t) > 1 and merge_all([ranks[bytes([b])] for b in t], pairs) != [r]],
        )

    def scalar(self, spark: SparkSession) -> Column:
        """The arrays as one struct: a one-row table that plans refer to, so that their text doesn't spell it out."""
        numbers = {x: pa.array([getattr(self, x)], pa.list_(pa.int32())) for x in ("offset", "owner")}
        texts = {x: pa.array([getattr(self, x)], pa.list_(pa.string())) for x in ("byte_chars", "merged")}
        row = spark.createDataFrame(pa.table(numbers | texts))
        return written(row.select(F.struct(*row.columns).alias("tables"))).scalar()


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lets(values: list[Column], body, *bound: Column) -> Column:
    """body(*values) with each value computed once."""
    return body(*bound) if not values else let(values[0], lambda x: lets(values[1:], body, *bound, x))


def word_line(word: Column, tables: Column, whole: list[tuple[bytes, int]]) -> Column:
    """The ids of one word, a character each. tables: RankMap.scalar(), or a variable bound to it."""
    line = lets([tables[x] for x in ("byte_chars", "offset", "owner", "merged")], lambda *own: _fold(word, *own))
    for token, rank in whole:
        line = F.when(F.encode(word, "UTF-8") == F.unhex(F.lit(token.hex())), F.lit(char(rank))).otherwise(line)
    return line


def _fold(word: Column, byte_chars: Column, offset: Column, owner: Column, merged: Column) -> Column:
    none = F.lit(NO_PAIR)

    def pair(a: Column, b: Column) -> Column:
        """The rank of tokens a and b, which may be no token, as a character."""
        at = F.get(offset, F.ascii(a)) + F.ascii(b)
        return F.when(F.get(owner, at) == F.ascii(a), F.get(merged, at)).otherwise(none)

    chars = F.filter(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
    start = F.transform(chars, lambda c: F.get(byte_chars, F.ascii(c)))
    state = lambda tokens, ranks: F.struct(tokens.alias("tokens"), ranks.alias("ranks"))

    def merge(now: Column, _: Column) -> Column:
        tokens, ranks = now["tokens"], now["ranks"]

        def joined(best: Column, p: Column) -> Column:
            # the rank of a pair is its token's id, so the character found among the ranks is the new token
            after = pair(best, F.substring(tokens, p + 2, F.lit(1)))
            before = pair(F.substring(tokens, p - 1, F.lit(1)), best)
            new = F.when(p > 1, F.overlay(ranks, F.concat(before, after), p - 1, F.lit(3))).otherwise(F.overlay(ranks, after, p, F.lit(2)))
            return state(F.overlay(tokens, best, p, F.lit(2)), new)

        found = lambda best: F.when(best == none, now).otherwise(let(F.instr(ranks, best), lambda p: joined(best, p)))
        return let(F.array_min(F.split(ranks, "")), found)

    first = lambda s: F.transform(s, lambda a, i: F.coalesce(pair(a, F.get(s, i + 1)), none))
    return let(start, lambda s: F.aggregate(F.slice(s, 2, F.size(s)), state(F.array_join(s, ""), F.array_join(first(s), "")), merge, lambda now: now["tokens"]))


def pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def hot_words(docs: DataFrame, tables: Column, ranks: RankMap, pattern: str, hot: int) -> str:
    """A folder of the shared store with the most frequent words (number, word, code). docs: text."""
    spark = docs.sparkSession
    every_nth = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every_nth)) == 0)
    words = sample.select(F.explode(F.array_distinct(pieces(F.col("text"), pattern))).alias("word")).where(F.octet_length("word") <= LONG_WORD)
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(hot)
    listed = written(top.agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("count"), "word"))), lambda x: x["word"]).alias("words")))
    dealt = listed.select(F.posexplode("words").alias("number", "word")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "number")
    folder = shared_dir(spark)
    dealt.withColumn("tables", tables).select("number", "word", let(F.col("tables"), lambda t: word_line(F.col("word"), t, ranks.whole)).alias("code")).write.parquet(folder)
    return folder


class HotWords:
    """The table of frequent words in a worker, in flat arrays; and how lines of ids are put together with it."""

    def __init__(self, folder: str, tokens: list[bytes]):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, path = filesystem(folder)
        files = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        table = pa.concat_tables([pq.read_table(store.open_input_file(f)) for f in files]).sort_by("number")
        self.n, code = table.num_rows, table.column("code")
        whole = pc.binary_join(pa.ListArray.from_arrays([0, self.n], code.combine_chunks()), "")
        self.flat, self.size = numbers_of(whole[0].as_py()).astype("<u4"), pc.utf8_length(code).to_numpy().astype(np.int32)
        self.data, offsets = utf8(table.column("word"))
        hashed = span_hashes(self.data, offsets[:-1], offsets[1:])
        self.number = np.argsort(hashed, kind="stable").astype(np.int32)
        self.hash, self.start, self.bytes = hashed[self.number], offsets[:-1].astype(np.int32), np.diff(offsets).astype(np.int32)
        self.tokens, self.ranks = tokens, None
        self.data = self.data.copy()
        del table, code, whole, files
        pa.default_memory_pool().release_unused()

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of each word, or -1: of words that aren't in the table, and of any that shares a hash with another."""
        start, size = offsets[:-1], np.diff(offsets)
        hashed, first, which = np.unique(span_hashes(data, start, offsets[1:]), return_index=True, return_inverse=True)
        found = np.full(len(hashed), -1)
        if self.n:
            place = np.minimum(np.searchsorted(self.hash, hashed), self.n - 1)
            hit = np.flatnonzero((self.hash[place] == hashed) & (self.bytes[self.number[place]] == size[first]))
            own = self.number[place[hit]]
            found[hit] = np.where(_alike(self.data, self.start[own], data, start[first[hit]], size[first[hit]]), own, -1)
        like = first[which]
        out = np.where(size == size[like], found[which], -1)
        known = np.flatnonzero(out >= 0)
        out[known[~_alike(data, start[known], data, start[like[known]], size[known])]] = -1
        return out

    def numbers(self, words: pa.Array) -> np.ndarray:
        """find() for many words, some bytes at a time: a byte takes about 60 while it is hashed."""
        data, offsets = utf8(words)
        out, at = [np.zeros(0, np.int64)], 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK // 4, "right")) - 1)
            out.append(self.find(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
            at = to
        return np.concatenate(out)

    def held(self, ids: list[str | None], words: pa.ListArray) -> list[list]:
        """For each text its id, its line and its other words in order. words: the pieces of each text."""
        flat, ends = words.flatten(), np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())]).tolist()
        numbers = self.numbers(flat)
        whole, others = line_of(numbers), np.flatnonzero(numbers < 0)
        texts, cuts = flat.take(pa.array(others)).to_pylist(), np.searchsorted(others, ends).tolist()
        return [[i, whole[ends[k] : ends[k + 1]], *texts[cuts[k] : cuts[k + 1]]] for k, i in enumerate(ids)]

    def long_word(self, word: str) -> str:
        self.ranks = self.ranks or {t: i for i, t in enumerate(self.tokens) if t}
        raw = word.encode()
        return "".join(map(char, [self.ranks[raw]] if raw in self.ranks else merge_long(raw, self.ranks)))

    def codes(self, words: list[str], found: list[str] | None) -> dict[str, str]:
        """The lines of ids of a text's other words: those that the join found, and long ones."""
        of = {word: code for code, _, word in (x.partition(MARK) for x in found or ())}
        for x in words:
            if x not in of:
                of[x] = self.long_word(x)
        return of

    def ids(self, held: list[list], codes: list[list[str] | None]) -> Iterator[np.ndarray]:
        """The ids of each text of held(); codes: code, MARK and word for its other words."""
        words = [self.codes(h[2:], found) if len(h) > 2 else {} for h, found in zip(held, codes, strict=True)]
        if self.n + sum(map(len, words)) < MOST:
            yield from self._together(held, words)
        else:  # more distinct words than there are characters: part by part
            for (_, line, *others), of in zip(held, words, strict=True):
                parts = [next(self._together([[None, x]], [{}])) for x in line.split(MARK)]
                between = [numbers_of(of[x]).astype("<u4") for x in others]
                yield np.concatenate([x for pair in zip(parts, [*between, np.zeros(0, "<u4")], strict=True) for x in pair])

    def _together(self, held: list[list], words: list[dict[str, str]]) -> Iterator[np.ndarray]:
        own: dict[str, str] = {}
        codes: list[str] = []
        whole = []
        for (_, line, *others), of in zip(held, words, strict=True):
            if others:
                for word, code in of.items():
                    if word not in own:
                        own[word] = char(self.n + len(codes))
                        codes.append(code)
                parts = [""] * (2 * len(others) + 1)
                parts[::2], parts[1::2] = line.split(MARK), [own[x] for x in others]
                line = "".join(parts)
            whole.append(line)
        flat = np.concatenate([self.flat, numbers_of("".join(codes)).astype("<u4")])
        size = np.concatenate([self.size, np.array([len(x) for x in codes], np.int64)])
        start = np.cumsum(size) - size
        number = numbers_of("".join(whole))
        out = flat[spread(start[number], size[number])]
        cut, at = np.concatenate([[0], np.cumsum(size[number])]), 0
        for line in whole:
            yield out[cut[at] : cut[at + len(line)]]
            at += len(line)


def _alike(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether two spans of one size hold the same bytes, for each pair of spans."""
    other = a[spread(a_start, size)] != b[spread(b_start, size)]
    out = np.ones(len(size), bool)
    out[np.repeat(np.arange(len(size)), size)[other]] = False
    return out


def lines(docs: DataFrame, ranks: RankMap, pattern: str, tables: Column, folder: str) -> DataFrame:
    """held, an array of the row's id as text, its line and its other words; and codes, the ids of these words.

    docs: doc_id, text.
    """
    tokens = ranks.tokens

    def run(batches):
        tool = HotWords(folder, tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                words = part.column(2)
                words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tool.held(part.column(1).to_pylist(), words), pa.list_(pa.string()))], names=["key", "held"])

    # rows that share a key share the words found, which does no harm, so a short key will do; id, line and words are one
    # column, so that both readers ask the exchange for the same
    key = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key")
    cut = docs.select(key, F.col("doc_id").cast("string").alias("doc_id"), pieces(text_or_empty("text"), pattern).alias("words"))
    kinds = T.StructType([T.StructField("key", T.LongType(), False), T.StructField("held", T.ArrayType(T.StringType()))])
    dealt = cut.mapInArrow(lean(run), kinds).repartition("key")
    others = F.filter(F.slice("held", 3, F.size("held")), lambda w: F.octet_length(w) <= LONG_WORD)
    # a plain explode, or a key that may be null, would put a filter below the exchange on this side only
    asked = dealt.select("key", F.explode_outer(F.array_distinct(others)).alias("word")).where("word IS NOT NULL").repartition("word")
    # the first key is asked for so that this reads the same exchange as the join
    words = asked.groupBy("word").agg(F.min("key").alias("first"))
    codes = words.withColumn("tables", tables).select("word", "first", let(F.col("tables"), lambda t: word_line(F.col("word"), t, ranks.whole)).alias("code"))
    found = asked.join(codes, "word").where("key >= first").select("key", F.concat("code", F.lit(MARK), "word").alias("code")).repartition("key")
    return dealt.join(found.groupBy("key").agg(F.collect_set("code").alias("codes")), "key", "left").select("held", "codes")


def decoded(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """Decoding: the joined bytes of the ids."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def mapped(docs: DataFrame, ranks: RankMap, pattern: str, hot: int, of, kinds: list[T.StructField]) -> DataFrame:
    """doc_id and the values of(ids) of each row of docs (doc_id, text)."""
    schema = T.StructType([T.StructField("doc_id", T.StringType()), *kinds])
    tables = ranks.scalar(docs.sparkSession)
    folder = hot_words(docs.select("text").where(F.col("text").isNotNull()), tables, ranks, pattern, min(hot, MOST // 2))
    tokens = ranks.tokens

    def run(batches):
        tool = HotWords(folder, tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                held, codes = part.column(0).to_pylist(), part.column(1).to_pylist()
                values = [of(ids) for ids in tool.ids(held, codes)]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.string()), *[pa.array(list(v)) for v in zip(*values, strict=True)]], names=schema.fieldNames())

    out = lines(docs, ranks, pattern, tables, folder).mapInArrow(lean(run), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def report(docs: DataFrame, ranks: RankMap, pattern: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, a row for each document."""
    tokens = ranks.tokens

    def digests(ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded(ids, tokens)).hexdigest()

    kinds = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return mapped(only(docs, doc_id=doc_id, text=text), ranks, pattern, hot, digests, kinds)


def encode(docs: DataFrame, ranks: RankMap, pattern: str, text: str = "text", hot: int = HOT) -> DataFrame:
    """docs with the ids (little-endian 32-bit, binary) in a new column token_ids; each distinct text is encoded once."""
    key, name = fresh(docs.columns, "text_key"), fresh(docs.columns, "token_ids")
    keyed = docs.withColumn(key, F.sha2(text_or_empty(f"`{text}`"), 256))
    texts = keyed.select(F.col(key).alias("doc_id"), F.col(f"`{text}`").alias("text")).dropDuplicates(["doc_id"])
    ids = mapped(texts, ranks, pattern, hot, lambda ids: (ids.tobytes(),), [T.StructField("ids", T.BinaryType())])
    return keyed.join(ids.select(F.col("doc_id").alias(key), F.col("ids").alias(name)), key, "left").drop(key)


def decode(docs: DataFrame, ranks: RankMap, ids: str = "token_ids") -> DataFrame:
    """docs with the decoded bytes of a column of ids (little-endian 32-bit, binary; null gives none) in a new column decoded."""
    tokens, name = ranks.tokens, fresh(docs.columns, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [None if x is None else decoded(np.frombuffer(x, "<u4"), tokens) for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=schema.fieldNames())

    return docs.mapInArrow(lean(run), schema)
