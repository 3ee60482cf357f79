"""Media columns: texts' bytes as 8-bit audio, and features of the audio.

store() builds a WAV file a row (mono, 8-bit unsigned samples, RATE a second) on the JVM; the payload is the text's UTF-8
bytes, padded with bytes 0. Any reader of WAV files gets the bytes back, and payload() does so in an expression.

features() reads such a column: samples are resampled to MODEL_RATE by a polyphase filter (a Kaiser-windowed sinc, as whole
numbers, so results are exact and the same in any order of sums), cut into overlapped frames, and each frame becomes the
logarithm of its mel filterbank. Frames are gathered into patches of a fixed shape; a document's patches are an Arrow stream
with a fixed-shape tensor column and the time span of each patch, in a binary column (tensors() reads it). Spans of sound
are found by hysteresis on the frames' energy: one opens OPEN_DB over the median and closes at CLOSE_DB under it.

Long audio is worked through in blocks of frames, so memory is bounded by the media itself and a few numbers a frame.

Defined results: a null text is an empty one, whose payload is 64 bytes 0; equal media give equal features; repeated rows
stay; null media have null features and no segments; extra columns pass through store() and features(), which refuse a column that exists already; a column without a WAV
file of that kind is an error; an empty table gives no rows. There is no shuffle.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import shared_dir
from folioscope.llm.hashing import lean, slices

RATE, MODEL_RATE = 16_000, 10_000
#: The payload's length is a multiple of this, and not 0.
ALIGN = 64
#: Frame, step and transform length in samples of MODEL_RATE: 25 and 10 milliseconds.
FRAME, STEP, FFT = 250, 100, 256
MELS, PATCH = 32, 16
FLOOR = 1e-8
OPEN_DB, CLOSE_DB = 1.5, -1.5
#: Frames worked on at once.
BLOCK = 8192
_HALF, _SCALE = 8, 1 << 14


# ---- the media column


def _le32(n: Column) -> Column:
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


def wav(payload: Column, rate: int = RATE) -> Column:
    """A WAV file of 8-bit samples around bytes."""
    size = F.octet_length(payload).cast("long")
    kind = struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(F.lit(b"RIFF"), _le32(size + 36), F.lit(b"WAVEfmt " + kind + b"data"), _le32(size), payload)


def payload(media: Column) -> Column:
    """The sample bytes of a file that wav() made, read by its data chunk's length."""
    reversed_size = F.hex(F.substring(media, 41, 4))
    size = F.conv(F.concat(*[F.substring(reversed_size, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.substr(media, F.lit(45), size)


def store(docs: DataFrame, text: str = "text", align: int = ALIGN, rate: int = RATE) -> DataFrame:
    """docs without the text, with n_bytes (before the padding) and media."""
    refuse(docs, "n_bytes", "media")
    raw = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    padded = F.rpad(raw, F.greatest(F.ceil(size / align), F.lit(1)).cast("int") * align, F.lit(b"\0"))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], size.cast("long").alias("n_bytes"), wav(padded, rate).alias("media"))


def refuse(rows: DataFrame, *names: str) -> None:
    if clash := {c.lower() for c in rows.columns} & set(names):
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")


def samples(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples) of a mono WAV file with 8-bit samples; chunks of other kinds are skipped."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("the WAV file ends early")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("samples must be mono and of 8 bits")
        elif name == b"data" and rate:
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


# ---- resampling


@functools.cache
def low_pass(up: int, down: int) -> np.ndarray:
    """Whole-number taps of the filter between the two rates, 1 / _SCALE each; their sum is up * _SCALE, nearly."""
    half = _HALF * max(up, down)
    t = np.arange(-half, half + 1) / max(up, down)
    return np.rint(np.sinc(t) * np.kaiser(2 * half + 1, 8.0) * _SCALE * up / max(up, down)).astype(np.int64)


class Resampler:
    """y[m] = sum over k of x[k] * taps[m * down - k * up + half], for all phases by one product of matrices.

    All numbers are whole and below 2^24, so 32-bit floats hold them exactly.
    """

    def __init__(self, rate: int, to: int):
        self.up, self.down = to // math.gcd(rate, to), rate // math.gcd(rate, to)
        taps = low_pass(self.up, self.down)
        half = len(taps) // 2
        self.reach = half // self.up  # inputs before a phase's place
        self.width = 2 * self.reach + 2 + (self.up - 1) * self.down // self.up
        self.bank = np.zeros((self.width, self.up), np.float32)
        for phase in range(self.up):
            for w in range(self.width):
                at = phase * self.down - (w - self.reach) * self.up + half
                if 0 <= at < len(taps):
                    self.bank[w, phase] = taps[at]
        assert np.abs(self.bank).sum(axis=0).max() * 128 < 1 << 24

    def length(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def __call__(self, raw: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Outputs start to stop, between -1 and 1, of unsigned samples; beyond both ends is silence, so are outputs."""
        stop = min(stop, self.length(len(raw)))
        first, last = start // self.up, -(-stop // self.up)
        if last <= first:
            return np.zeros(0, np.float32)
        a, b = first * self.down - self.reach, (last - 1) * self.down - self.reach + self.width
        x = np.zeros(b - a, np.float32)
        low, high = max(a, 0), min(b, len(raw))
        x[low - a : high - a] = raw[low:high]
        x[low - a : high - a] -= 128
        rows = np.lib.stride_tricks.as_strided(x, (last - first, self.width), (x.strides[0] * self.down, x.strides[0]))
        out = (np.ascontiguousarray(rows) @ self.bank).ravel()
        return out[start - first * self.up : stop - first * self.up] / np.float32(128 * _SCALE)


@functools.cache
def resampler(rate: int, to: int) -> Resampler:
    return Resampler(rate, to)


# ---- frames


@functools.cache
def mel_bank(rate: int, fft: int, mels: int) -> np.ndarray:
    """Triangles of equal width on the mel scale, from 0 to half the rate: (fft / 2 + 1) x mels."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1)[:, None] * rate / fft
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0).astype(np.float32)


@functools.cache
def window(n: int) -> np.ndarray:
    return (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n)).astype(np.float32)


def frames(raw: np.ndarray, rate: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel, energy in dB) of each frame; the last is filled up with silence."""
    tool = resampler(rate, MODEL_RATE)
    n = tool.length(len(raw))
    count = 1 + max(0, -(-(n - FRAME) // STEP))
    mel, energy = np.empty((count, MELS), np.float16), np.empty(count, np.float32)
    for at in range(0, count, block):
        to = min(count, at + block)
        y = np.zeros((to - 1 - at) * STEP + FRAME, np.float32)
        part = tool(raw, at * STEP, (to - 1) * STEP + FRAME)
        y[: len(part)] = part
        rows = np.lib.stride_tricks.as_strided(y, (to - at, FRAME), (y.strides[0] * STEP, y.strides[0]))
        energy[at:to] = 10 * np.log10(np.einsum("ij,ij->i", rows, rows) / FRAME + FLOOR)
        power = np.abs(np.fft.rfft(rows * window(FRAME), FFT)) ** 2
        mel[at:to] = np.log10(power.astype(np.float32) @ mel_bank(MODEL_RATE, FFT, MELS) + np.float32(FLOOR))
    return mel, energy


def sounding(energy: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> np.ndarray:
    """(first frame, frame after the last) of each span: one opens at a frame of open_db over the median at least, and
    closes at the first frame under close_db."""
    middle = np.median(energy)
    mark = np.where(energy >= middle + open_db, 1, np.where(energy < middle + close_db, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[last] > 0), [False]])
    return np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)


def spans(first: np.ndarray, after: np.ndarray, n: int, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end in microseconds of runs of frames, within audio of n samples."""
    end = n * 1_000_000 // rate
    return first * STEP * 1_000_000 // MODEL_RATE, np.minimum(((after - 1) * STEP + FRAME) * 1_000_000 // MODEL_RATE, end)


# ---- tensors

_TENSOR = pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS), dim_names=("frame", "mel"))
_TENSORS = pa.schema([("start_us", pa.int64()), ("end_us", pa.int64()), ("patch", _TENSOR)])


def packed(mel: np.ndarray, n: int, rate: int) -> bytes:
    """An Arrow stream of patches with their time spans; the last patch is filled up with the floor."""
    count = -(-len(mel) // PATCH)
    filled = np.full((count * PATCH, MELS), np.log10(FLOOR), np.float16)
    filled[: len(mel)] = mel
    first = np.arange(count) * PATCH
    start, end = spans(first, np.minimum(first + PATCH, len(mel)), n, rate)
    inner = pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), PATCH * MELS)
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.ExtensionArray.from_storage(_TENSOR, inner)], schema=_TENSORS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TENSORS) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patches x frames x mels, start_us, end_us) from a stored Arrow stream."""
    found = pa.ipc.open_stream(stored).read_all().combine_chunks()
    patches = found["patch"].combine_chunks()
    patches = patches.chunk(0) if isinstance(patches, pa.ChunkedArray) else patches
    return patches.to_numpy_ndarray(), found["start_us"].to_numpy(), found["end_us"].to_numpy()


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """media's other columns with n_samples, rate, n_frames, tensors and segments (start and end in microseconds)."""
    refuse(media, "n_samples", "rate", "n_frames", "tensors", "segments")
    others = [c for c in media.columns if c != column]
    rows = media.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"), F.col(f"`{column}`").alias("media"))
    span = T.ArrayType(T.StructType([T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType())]))
    own = {"n_samples": T.LongType(), "rate": T.IntegerType(), "n_frames": T.LongType(), "tensors": T.BinaryType(), "segments": span}
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, t) for c, t in own.items()]])
    pairs = pa.struct([("start_us", pa.int64()), ("end_us", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, rows=500):
                lengths, rates, counts, stored, starts, ends, bounds = [], [], [], [], [], [], [0]
                for raw in part.column(1):
                    bounds.append(bounds[-1])
                    if not raw.is_valid:
                        for column in (lengths, rates, counts, stored):
                            column.append(None)
                        continue
                    rate, own = samples(memoryview(raw.as_buffer()).tobytes())
                    mel, energy = frames(own, rate)
                    found = sounding(energy)
                    start, end = spans(found[:, 0], found[:, 1], len(own), rate)
                    lengths.append(len(own))
                    rates.append(rate)
                    counts.append(len(mel))
                    stored.append(packed(mel, len(own), rate))
                    starts.append(start)
                    ends.append(end)
                    bounds[-1] += len(start)
                inner = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *x]).astype(np.int64)) for x in (starts, ends)], fields=list(pairs))
                segments = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(rates, pa.int32()), pa.array(counts, pa.int64()), pa.array(stored, pa.binary()), segments], names=schema.names)

    done = rows.mapInArrow(lean(run), schema)
    return done.select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(others)], *own)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the media table, reads it back, and gives its digests and those of its features, a row for each document.

    feature: frames, spans of sound, microseconds of sound, and the digest of the stored tensors.
    """
    spark = docs.sparkSession
    made = store(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    path = shared_dir(spark)
    made.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    held = payload(F.col("media"))
    digests = stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length(held).cast("long").alias("payload_bytes"),
        F.sha2(held, 256).alias("payload_sha256"),
        F.crc32(F.substring(held, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "media",
    )
    found = features(digests)
    sound = F.aggregate(F.transform("segments", lambda s: s["end_us"] - s["start_us"]), F.lit(0).cast("long"), lambda a, x: a + x)
    feature = F.concat_ws(":", F.col("n_frames").cast("string"), F.size("segments").cast("string"), sound.cast("string"), F.sha2("tensors", 256))
    return found.select(*[c for c in digests.columns if c != "media"], feature.alias("feature"))
