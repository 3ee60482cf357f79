"""Quality rules with Spark expressions only: counts within a text, then line frequency across documents.

Base figures of a text: words, code points in words, symbols, repeated lines, words in repeated 8-word windows.

Cross-document verdict: every line with a word is normalised (lower case, digits to 0, white space collapsed) and
hashed; for each host the *distinct texts* that hold the line are counted. A line of any length is boilerplate where
more than ``max(min_docs, share * texts of the host)`` texts hold it. Boilerplate lines are removed; a document with
less than ``min_left`` of its words left is depleted and rejected. Exact copies count as one text, so they are left to
the duplicate operators.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; rows with
the same id are judged each by its own text; extra columns pass through ``clean``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SPACE_CLASS, fresh, only, text_or_empty, written

SYMBOL_CLASS = r"[#*$%&|<>]"
NO_SPACE = r"[^\x20\x09-\x0D]"
WINDOW = 8
#: Places of windows that fit beside a hash in one long.
PLACE_BITS = 24
PLACES = 1 << PLACE_BITS


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    max_repeat_percent: int = 30
    min_docs: int = 20
    share: float = 0.01
    min_left: float = 0.2


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def window_hashes(w: Column) -> Column:
    """A hash for each run of WINDOW words: each word is hashed once, runs of two, four and eight are joined of halves."""

    def doubled(size: int):
        starts = lambda r: F.slice(r, 1, F.greatest(F.size(r) - size, F.lit(0)))
        return lambda r: F.transform(starts(r), lambda x, i: F.xxhash64(x, F.get(r, i + size)))

    runs, size = F.transform(w, lambda x: F.xxhash64(x)), 1
    while size < WINDOW:
        runs, size = bound(runs, doubled(size)), 2 * size
    return runs


def repeat_words(w: Column) -> Column:
    """Words inside 8-word windows that occur twice or more.

    Windows are compared by a 64-bit hash. One long holds the upper bits of a hash and the window's place in the rest;
    these are sorted, and each is compared with its neighbours. Where neighbours agree in the upper bits only, or there
    are more windows than places, (hash, place) pairs are sorted instead. No step is quadratic in the text.
    """
    place, zero = F.lit(PLACES - 1).cast("long"), F.lit(0).cast("long")

    def spans(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")), zero, lambda a, x: a + x)

    def by_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        one = lambda p: F.transform(F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
        return F.sort_array(bound(pairs, one))

    def by_longs(h: Column) -> Column:
        alike = lambda x, y: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))
        at = lambda x: x.bitwiseAND(place).cast("int")
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-PLACES)).bitwiseOR(i.cast("long"))))
        twice = bound(packed, lambda p: F.filter(p, lambda x, k: alike(x, F.get(p, k + 1)) | alike(x, F.get(p, k - 1))))

        def exact(t: Column) -> Column:
            clash = F.exists(F.transform(t, lambda x, k: alike(x, F.get(t, k + 1)) & (F.get(h, at(x)) != F.get(h, at(F.get(t, k + 1))))), lambda x: x)
            return F.when(clash, by_pairs(h)).otherwise(F.sort_array(F.transform(t, at)))

        return bound(twice, exact)

    def covered(h: Column) -> Column:
        return bound(F.when(F.size(h) < PLACES, by_longs(h)).otherwise(by_pairs(h)), spans)

    return F.when(F.size(w) <= WINDOW, zero).otherwise(bound(window_hashes(w), covered))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: a let-binding made of a one-element transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_word(line: Column) -> Column:
    return line.rlike(NO_SPACE)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), has_word)


def figures(text: Column) -> Column:
    """Struct of the base figures of a text that isn't null; its words are split once."""

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"),
            bound(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return bound(words(text), of)


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE_CLASS + "+", " ")), "[0-9]", "0")


def line_key(line: Column) -> Column:
    """Struct of the normalised line's hash and its number of words."""
    return bound(normalised(line), lambda n: F.struct(F.xxhash64(n).alias("h"), (F.octet_length(n) - F.octet_length(F.replace(n, F.lit(" "), F.lit(""))) + 1).alias("n")))


def line_keys(text: Column) -> Column:
    return F.transform(lines_with_words(text), line_key)


def boilerplate(docs: DataFrame, limits: Limits) -> DataFrame:
    """host, h of every boilerplate line; docs has host and text. Partial sums run before each shuffle."""
    held = docs.select("host", F.xxhash64("text").alias("t"), F.explode(F.array_distinct(F.transform(lines_with_words(F.col("text")), lambda x: F.xxhash64(normalised(x))))).alias("h"))
    counted = held.groupBy("host", "h", "t").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > limits.min_docs)
    hosts = docs.select("host", F.xxhash64("text").alias("t")).groupBy("host", "t").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all"))
    return counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).where(F.col("n") > F.col("all") * limits.share).select(counted["host"], "h")


#: Boilerplate hashes (8 bytes each) up to which the table is broadcast; beyond it Spark joins by shuffle.
BROADCAST_HASHES = 2_000_000


def with_boilerplate(docs: DataFrame, limits: Limits) -> tuple[DataFrame, str]:
    """docs (host, text and more) with the array of its host's boilerplate hashes; and that column's name.

    A host has few such lines: each takes a share of its texts, so their number is at most lines per text / share.
    The number of hosts has no bound, so the table is counted before it is broadcast.
    """
    bad_name, key = fresh(docs.columns, "bad"), fresh(docs.columns, "bad_host")
    bad = written(boilerplate(docs.select("host", "text"), limits))
    by_host = bad.groupBy(F.col("host").alias(key)).agg(F.collect_set("h").alias(bad_name))
    if bad.count() <= BROADCAST_HASHES:
        by_host = F.broadcast(by_host)
    joined = docs.join(by_host, docs["host"].eqNullSafe(by_host[key]), "left").drop(key)
    return joined.withColumn(bad_name, F.coalesce(F.col(bad_name), F.array().cast("array<bigint>"))), bad_name


def removed_words(bad: Column) -> Column:
    keys = F.filter(line_keys(F.col("text")), lambda k: F.array_contains(bad, k["h"]))
    return F.when(F.size(bad) == 0, F.lit(0)).otherwise(F.aggregate(F.transform(keys, lambda k: k["n"]), F.lit(0), lambda a, x: a + x))


def base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def depleted(limits: Limits) -> Column:
    return (F.col("n_words") - F.col("n_removed_words")) < limits.min_left * F.col("n_words")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """doc_id, base figures, base_failed, n_removed_words and kept, a row for each row of docs."""
    own = only(docs, doc_id=doc_id, text=text, host=host).withColumn("text", text_or_empty("text"))
    marked, bad = with_boilerplate(own, limits)
    found = marked.select("doc_id", figures(F.col("text")).alias("f"), removed_words(F.col(bad)).cast("long").alias("n_removed_words"))
    judged = found.select("doc_id", "f.*", "n_removed_words").withColumn("base_failed", base_failed(limits))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted(limits))


def clean(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits(), n_chars: str | None = "n_chars") -> DataFrame:
    """The kept documents without their boilerplate lines; all columns stay, n_chars follows the text."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{host}`").alias("host"))
    marked, bad = with_boilerplate(inner, limits)
    found = marked.select("row", "text", bad, figures(F.col("text")).alias("f"), removed_words(F.col(bad)).alias("n_removed_words"))
    judged = found.select("row", "text", bad, "f.*", "n_removed_words").where(~base_failed(limits) & ~depleted(limits))
    keep_line = lambda x: ~has_word(x) | bound(line_key(x), lambda k: ~F.array_contains(F.col(bad), k["h"]))
    left = F.when(F.col("n_removed_words") == 0, F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), keep_line), "\n"))
    cleaned = judged.select("row", left.alias("text"))
    return cleaned.select(*[replaced(docs, c, text, n_chars) for c in docs.columns])


def replaced(docs: DataFrame, c: str, text: str, n_chars: str | None) -> Column:
    """Column c of the struct row, but the new text, and its length, for those two columns."""
    if c == text:
        return F.col("text").alias(c)
    if c == n_chars:
        return F.char_length("text").cast(docs.schema[c].dataType).alias(c)
    return F.col("row").getField(c).alias(c)
