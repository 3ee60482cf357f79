"""Fill-in-the-middle transformation: whole texts cut at two units, found through a sparse checkpoint index.

A unit is a run of letters A-Z and a-z, or any other single code point. One scan over a text's bytes counts its units
and notes the unit number, byte offset and code-point offset of every STEP-th unit; a cut finds the last checkpoint at or
before it by binary search and scans from there to its unit, so no list of all units is ever held. Scans read PIECE bytes
at a time.

Where to cut, and which form to write, comes from a hash of the document's id, so each run, task and retry agrees. The
output needs no table of offsets to be undone: a text that holds a sentinel stays plain, so sentinels are unambiguous.

Defined results: a null text is empty, an empty one plain with no units; a null id hashes as an empty one; rows that are
equal, or share an id, are cut alike; extra columns pass through, and those named like a result column keep their name while
the result takes a fresh one; an empty table gives no rows. There is no shuffle: each row is done where it is read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import fresh
from folioscope.llm.hashing import lean, slices, utf8

#: Units from one checkpoint to the next.
STEP = 512
#: Bytes scanned at once.
PIECE = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Index:
    """Checkpoints (unit, byte, code point) of a text, and its totals."""

    def __init__(self, data: np.ndarray, step: int = STEP, piece: int = PIECE):
        self.data, self.piece = data, piece
        self.unit, self.byte, self.point = [], [], []
        self.units = self.points = 0
        for at, point, unit in self._scan(0):
            places = np.flatnonzero(unit)
            marks = places[-self.units % step :: step]
            if len(marks):
                before = np.concatenate([[0], np.cumsum(np.add.reduceat(point, marks, dtype=np.int64))[:-1]]) + np.count_nonzero(point[: marks[0]])
                self.unit += range(self.units + -self.units % step, self.units + len(places), step)
                self.byte += (marks + at).tolist()
                self.point += (before + self.points).tolist()
            self.units += len(places)
            self.points += np.count_nonzero(point)

    def _scan(self, start: int):
        """(offset, where code points begin, where units begin) of each piece from start on, which begins a unit."""
        for at in range(start, len(self.data), self.piece):
            part = self.data[at : at + self.piece]
            point, letter = (part & 0xC0) != 0x80, _LETTER[part]
            goes_on = letter.copy()
            goes_on[1:] &= letter[:-1]
            goes_on[0] &= at > start and bool(_LETTER[self.data[at - 1]])
            yield at, point, point & ~goes_on

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which a unit begins; the ends of the text for the number after the last one."""
        if unit >= self.units:
            return len(self.data), self.points
        near = bisect_right(self.unit, unit) - 1
        left, points = unit - self.unit[near], self.point[near]
        for at, point, starts in self._scan(self.byte[near]):
            places = np.flatnonzero(starts)
            if left < len(places):
                return at + int(places[left]), points + int(np.count_nonzero(point[: places[left]]))
            left -= len(places)
            points += int(np.count_nonzero(point))
        raise AssertionError("a unit counted before is missing")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, h3: Column, h4: Column, plain_percent: int, spm_percent: int) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_percent)
    return F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs with units, form, prefix_chars, middle_chars and output (the text as it is trained on)."""
    names = docs.columns
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{doc_id}`"), seed)
    rows = docs.select(F.struct(F.lit(True).alias(fresh(names, "_")), *[F.col(f"`{c}`") for c in names if c != text]).alias("row"), whole.alias("text"), h1.alias("h1"), h2.alias("h2"), form_of(whole, h3, h4, plain_percent, spm_percent).alias("form"), F.col(f"`{text}`").isNull().alias("missing"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = utf8(part.column(1))
                form, missing = part.column(4).to_pylist(), part.column(5).to_pylist()
                n, prefix, middle, output, texts = [], [], [], [], []
                for i, (h1, h2) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    own = data[offsets[i] : offsets[i + 1]]
                    index, raw = Index(own), own.tobytes()
                    n.append(index.units)
                    texts.append(None if missing[i] else raw)
                    if form[i] == "plain":
                        prefix.append(None)
                        middle.append(None)
                        output.append(raw)
                        continue
                    (a, chars_a), (b, chars_b) = (index.cut(k) for k in sorted((h1 % (index.units + 1), h2 % (index.units + 1))))
                    prefix.append(chars_a)
                    middle.append(chars_b - chars_a)
                    pieces = (b"<P>", raw[:a], b"<S>", raw[b:]) if form[i] == "psm" else (b"<S>", raw[b:], b"<P>", raw[:a])
                    output.append(b"".join((*pieces, b"<M>", raw[a:b])))
                strings = [pa.array(x, pa.binary()).cast(pa.string()) for x in (texts, output)]
                yield pa.RecordBatch.from_arrays([part.column(0), strings[0], pa.array(n, pa.int64()), part.column(4), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), strings[1]], names=schema.names)

    done = rows.mapInArrow(lean(run), schema)
    own, taken = [], list(names)
    for c in ("n", "form", "prefix_chars", "middle_chars", "output"):
        own.append(F.col(c).alias(fresh(taken, c)))
        taken.append(fresh(taken, c))
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names], *own)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from what transform() wrote and its form alone."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: a row for each document."""
    found = transform(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), **options)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
