"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order::

    block* | index | Bloom filter | footer

* block: zstd of entries ``shared, unshared, value length (varints), key suffix, value``; a key leaves out the bytes it
  shares with the key before it, and every block starts anew;
* index: first key, offset and length of each block (sparse: one entry for BLOCK_BYTES of values);
* Bloom filter over the keys, about 1 % false positives;
* footer (64 bytes): places of index and filter, counts, width of an id, magic.

A key is 9 bytes whose order is that of the identifier (a flag, then the big-endian number with its sign flipped), so a
lookup asks the filter, bisects the index and reads one block (more if equal keys go on). Ids are stored as 16-bit
numbers if the vocabulary allows, else as 32-bit ones.

Shards are written by the executors that encode, each to a file named after its task attempt; a shard counts only
once its task has returned its manifest row, so a lost or repeated task does no harm. The manifest has one row a shard.

Defined results: a null text is empty (only the end id); a null identifier sorts first; rows with the same
identifier are all kept, in the order of their texts' hashes; extra columns are ignored; an empty table has no shards.
"""

from __future__ import annotations

import bisect
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import filesystem, only, shared_dir, text_or_empty
from folioscope.llm.hashing import CHUNK, lean, span_hashes, spread, U64, utf8

MAGIC = b"FOLIOSST"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    def __init__(self, stream, width: int):
        self.stream, self.width, self.at = stream, width, 0
        self.block, self.size, self.last, self.first = [], 0, b"", None
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.docs = self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value]
        self.size += len(value) + 4
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.tokens += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.first is not None:
            raw = self.pack.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(raw)))
            self._write(raw)
            self.block, self.size, self.first = [], 0, None

    def _write(self, raw: bytes) -> int:
        self.stream.write(raw)
        self.at += len(raw)
        return len(raw)

    def close(self) -> None:
        self.flush()
        index_at = self.at
        index_size = self._write(b"".join(key + struct.pack("<QI", at, size) for key, at, size in self.index))
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        bloom_at = self.at
        bloom_size = self._write(np.packbits(bloom, bitorder="little").tobytes())
        self._write(FOOTER.pack(index_at, index_size, bloom_at, bits, self.docs, self.tokens, self.width, bloom_size, MAGIC))


class Reader:
    """A shard as a file-like object with random access."""

    def __init__(self, file):
        self.file = file
        size = file.size() if hasattr(file, "size") else file.seek(0, io.SEEK_END)
        footer = self._at(size - FOOTER.size, FOOTER.size)
        index_at, index_size, self.bloom_at, self.bits, self.docs, self.tokens, self.width, self.bloom_size, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw = self._at(index_at, index_size)
        self.first = [raw[i : i + 9] for i in range(0, index_size, 21)]
        self.place = [struct.unpack("<QI", raw[i + 9 : i + 21]) for i in range(0, index_size, 21)]
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        raw, at, key = self.unpack.decompress(self._at(*self.place[i])), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            unshared, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + unshared]
            at += unshared
            yield key, raw[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.place)):
            for key, value in self.block(i):
                yield id_of(key), self.ids(value)

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def maybe(self, doc_id: int | None) -> bool:
        bloom = self._at(self.bloom_at, self.bloom_size)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, found = key_of(doc_id), []
        if not self.first or not self.maybe(doc_id):
            return found
        i = max(0, bisect.bisect_left(self.first, key) - 1)
        while i < len(self.first) and self.first[i] <= key:
            found += [self.ids(v) for k, v in self.block(i) if k == key]
            i += 1
        return found


#: Bytes that are white space or a mark alone; what else is white space has more bytes (see _odd).
SPACES = np.zeros(256, bool)
SPACES[[0, *range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_CUT = np.zeros(256, bool)
_CUT[[0x0A, 0x20]] = True
_STOP, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have white space but single spaces and line feeds."""
    space = SPACES[data]
    bad = space & ~_CUT[data]
    double = space[1:] & space[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    double[inner - 1] = False  # a text's end and the start of the next one
    bad[1:] |= double
    wide = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(wide):
        a, b, c = data[wide].astype(np.int64), *(data[np.minimum(wide + k, len(data) - 1)].astype(np.int64) for k in (1, 2))
        code = np.where(a == 0xC2, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63)
        bad[wide] |= np.isin(code, [x for x in range(0x80, 0x3001) if chr(x).isspace()])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
    return out


class Memory:
    """Chunks (bytes) with their ids, found by hash and compared by bytes; all in flat arrays.

    When there are more than limit of them, those used longest ago go, half of all at least.
    """

    def __init__(self, limit: int, kind: np.dtype):
        self.limit, self.clock = limit, 0
        self.hash, self.used = np.zeros(0, U64), np.zeros(0, np.int64)
        self.text, self.at, self.size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.id_at, self.id_size = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hashed: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bool]:
        """The place of each chunk, or -1; and whether one met another chunk of its hash. Entries are sorted by hash."""
        if not len(self.hash):
            return np.full(len(hashed), -1), False
        place = np.minimum(np.searchsorted(self.hash, hashed), len(self.hash) - 1)
        hit = self.hash[place] == hashed
        own = place[hit]
        clash = (self.size[own] != size[hit]).any() or (self.text[spread(self.at[own], size[hit])] != data[spread(start[hit], size[hit])]).any()
        self.clock += 1
        self.used[own] = self.clock
        return np.where(hit, place, -1), bool(clash)

    def add(self, hashed: np.ndarray, chunks: list[bytes], raws: list[bytes]) -> None:
        if len(self.hash) + len(chunks) > self.limit:
            self.keep(np.flatnonzero(self.used > np.median(self.used)) if len(self.used) else np.zeros(0, np.int64))
        size, id_size = (np.array([len(x) for x in y], np.int64) for y in (chunks, raws))
        id_size //= self.ids.itemsize
        order = np.argsort(hashed, kind="stable")
        into = np.searchsorted(self.hash, hashed[order])
        both = [
            ("at", len(self.text) + np.cumsum(size) - size), ("size", size), ("id_at", len(self.ids) + np.cumsum(id_size) - id_size), ("id_size", id_size),
            ("used", np.full(len(size), self.clock)), ("hash", hashed),
        ]
        for name, new in both:
            setattr(self, name, np.insert(getattr(self, name), into, new[order]))
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(chunks), np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raws), self.ids.dtype)])

    def keep(self, which: np.ndarray) -> None:
        self.text, self.ids = self.text[spread(self.at[which], self.size[which])], self.ids[spread(self.id_at[which], self.id_size[which])]
        for name in ("hash", "used", "size", "id_size"):
            setattr(self, name, getattr(self, name)[which])
        self.at, self.id_at = np.cumsum(self.size) - self.size, np.cumsum(self.id_size) - self.id_size


#: A text and where the tokenizer must cut it: a letter and the comma or full stop after it are never one piece.
PROBE = "ab,cd. ef\n gh  x", ["ab", ",", "cd", ".", "Ġef", "Ċ", "Ġgh", "Ġ", "Ġx"]


class Encoder:
    """Whole texts by the tokenizers library, which sees each distinct chunk once.

    The tokenizer splits before every white space that follows something else, so a text may be cut there and its
    chunks encoded apart; so may a comma or full stop at the end of a chunk that follows a letter. The chunks of many
    texts are hashed at once, each is compared by its bytes with the first one of its hash, and the distinct ones are
    looked up in a memory of ENTRIES chunks. Texts with other white space than single spaces and line feeds are cut by a
    pattern.
    """

    ENTRIES = 1_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        cut = self.library.pre_tokenizer
        if self.library.normalizer is not None or cut is None or [x for x, _ in cut.pre_tokenize_str(PROBE[0])] != PROBE[1]:
            raise ValueError(f"{path}: not a byte-level tokenizer that splits words, punctuation and white space")
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}  # what the library has just been asked for
        self.memory = Memory(self.ENTRIES, np.dtype(f"<u{self.width}"))
        vocabulary = self.library.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each token: one a character of its name
        for name, i in vocabulary.items():
            self.sizes[i] = len(name)
        self.chunk = re.compile(r"\s*\S+|\s+")

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def learn(self, new: set[str]) -> None:
        ends = [c for c in new if len(c) > 2 and c[-1] in ",." and c[-2].isalpha()]
        whole = {c for c in new if c not in self.known}
        whole.difference_update(ends)
        whole.update(b for c in ends if (b := c[:-1]) not in self.known)
        whole.update(b for b in (",", ".") if b not in self.known)
        joined = [c for c in whole if len(c) > 1 and c[0] == " " and not c[1].isspace()]
        alone = list(whole.difference(joined))
        for c, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.known[c] = self.raw(e.ids)
        self._learn_joined(joined)
        for c in ends:
            self.known[c] = self.known[c[:-1]] + self.known[c[-1]]

    def _learn_joined(self, new: list[str]) -> None:
        """Chunks that start with one space, many to a call: a join of them is cut apart again by the tokens' bytes."""
        parts = [new[i : i + 256] for i in range(0, len(new), 256)]
        for part, e in zip(parts, self.library.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(c.encode()) for c in part])
            cuts = np.searchsorted(ends, wanted) + 1
            if not (ends[cuts - 1] == wanted).all():
                raise ValueError("the tokenizer joins what lies before a white space with it")
            raw, at = ids.astype(f"<u{self.width}").tobytes(), 0
            for c, cut in zip(part, (cuts * self.width).tolist(), strict=True):
                self.known[c] = raw[at:cut]
                at = cut

    def encode(self, texts: pa.Array) -> list[bytes]:
        data, offsets = utf8(texts)
        out: list[bytes] = []
        row, rows = 0, len(offsets) - 1
        while row < rows:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            out += self._encode(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
            row = to
        return out

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        plain = lambda k: b"".join(self.ask(self.chunk.findall(data[offsets[k] : offsets[k + 1]].tobytes().decode())))
        if not len(data):
            return [b""] * (len(offsets) - 1)
        cuts = _CUT[data]
        cuts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        cuts[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]] & np.append(cuts[2:], True)  # a last comma or full stop
        start = np.flatnonzero(cuts)
        size = np.diff(start, append=len(data))
        hashed, first, which = np.unique(span_hashes(data, start, start + size), return_index=True, return_inverse=True)
        like = first[which]  # for each chunk the first one with its hash
        clash = (size != size[like]).any() or (data != data[spread(start[like], size)]).any()
        memory = self.memory
        place, other = (None, True) if clash else memory.find(hashed, data, start[first], size[first])
        if other:  # two chunks of one hash
            return [plain(k) for k in range(len(offsets) - 1)]
        new, old = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        chunks = [data[a : a + n].tobytes() for a, n in zip(start[first[new]].tolist(), size[first[new]].tolist(), strict=True)]
        # a chunk of a text that is cut by a pattern may be part of a word only; its ids are not asked for
        raws = self.ask([c.decode() for c in chunks])
        at, n = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        at[old], n[old] = memory.id_at[place[old]], memory.id_size[place[old]]
        n[new] = [len(x) // self.width for x in raws]
        at[new] = len(memory.ids) + np.cumsum(n[new]) - n[new]
        flat = np.concatenate([memory.ids, np.frombuffer(b"".join(raws), memory.ids.dtype)])
        if len(new):
            memory.add(hashed[new], chunks, raws)
        took = n[which]
        ids = flat[spread(at[which], took)]
        bounds = np.concatenate([[0], np.cumsum(took)])[np.searchsorted(start, offsets)].tolist()
        odd = _odd(data, offsets)
        return [plain(k) if odd[k] else ids[bounds[k] : bounds[k + 1]].tobytes() for k in range(len(bounds) - 1)]

    def ask(self, chunks: list[str]) -> list[bytes]:
        self.known = {}
        self.learn(set(chunks))
        found, self.known = [self.known[c] for c in chunks], {}
        return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, end_id: int, to: str, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Encodes and writes all documents; returns the manifest, a dict for each shard, in key order.

    tokenizer: the vocabulary file's path on the executors. to: URI of a folder in the shared store.
    """
    own = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = own.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches):
        tool = encoder(tokenizer)
        end = tool.raw([end_id])
        fs, folder = filesystem(to)
        fs.create_dir(folder, recursive=True)
        path, writer, stream, first = f"{folder}/{uuid.uuid4().hex}.sst", None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = part.column(0).to_pylist()
                if writer is None:
                    stream = fs.open_output_stream(path)
                    writer, first = Writer(stream, tool.width), ids[0]
                for i, raw in zip(ids, tool.encode(part.column(1)), strict=True):
                    writer.add(key_of(i), raw + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([first], pa.int64()), pa.array([writer.docs], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["path", "first", "docs", "tokens"])

    shards = dealt.mapInArrow(lean(run), "path string, first long, docs long, tokens long").select(F.spark_partition_id().alias("part"), "*").collect()
    start, out = 0, []
    for s in sorted(shards, key=lambda s: s["part"]):
        out.append({"path": s["path"], "first": s["first"], "docs": s["docs"], "tokens": s["tokens"], "start": start})
        start += s["tokens"]
    return out


def read(spark: SparkSession, manifest: list[dict], to: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, read from the shards."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(s["path"], s["start"]) for s in manifest], "path string, start long").repartition(len(manifest))

    def run(batches):
        fs, _ = filesystem(to)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(path) as file:
                    for doc_id, ids in Reader(file):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=schema.fieldNames())

    return shards.mapInArrow(lean(run), schema)


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    to = shared_dir(spark)
    return read(spark, write(docs, tokenizer, end_id, to, doc_id, text), to)
