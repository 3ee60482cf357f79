"""Quotes looked up in all texts through an index of rare grams.

Every quote is filed under one gram that any text with the quote must hold: three words in a row from its inside (the first
and last word may be parts of longer words in the text), one inner word if it has fewer, or a few characters if it has no
inner word. Of a quote's grams the one that the fewest quotes share is taken. A text probes the index with its own distinct
grams, of the kinds that the index has; only what meets is compared, and only hits come out.

Texts are not shuffled for the probing, only their hashed grams; a quote and a text meet once, by an equality join that
Spark may split where a gram is frequent. Defined results: null, blank quotes and null texts have no hits; rows that are
equal have their hits each; a quote occurs or not, so a second occurrence changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import fold_citation, folded_citation_page, let

#: Words of a gram, and characters of one of a quote without inner words.
WORDS, CHARS = 3, 3


def _runs(items: Column, n: int) -> Column:
    """Hashes of all runs of n items."""
    every = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(n)]))
    return let(items, lambda t: F.when(F.size(t) >= n, every(t)).otherwise(F.array().cast("array<bigint>")))


def _words(folded: Column) -> Column:
    return F.split(folded, " ")


def _characters(folded: Column) -> Column:
    return F.filter(F.split(folded, ""), lambda c: c != "")


def quote_grams(needle: Column) -> Column:
    """struct<kind, grams> of a folded quote."""
    inner = F.slice(_words(needle), 2, F.greatest(F.size(_words(needle)) - 2, F.lit(0)))
    length = F.least(F.char_length(needle), F.lit(CHARS))
    by_chars = [F.when(length == n, _runs(_characters(needle), n)) for n in range(1, CHARS + 1)]
    return (
        F.when(F.size(inner) >= WORDS, F.struct(F.lit(f"w{WORDS}").alias("kind"), _runs(inner, WORDS).alias("grams")))
        .when(F.size(inner) > 0, F.struct(F.lit("w1").alias("kind"), _runs(inner, 1).alias("grams")))
        .otherwise(F.struct(F.concat(F.lit("c"), length.cast("string")).alias("kind"), F.coalesce(*by_chars).alias("grams")))
    )


def index(quotes: DataFrame) -> DataFrame:
    """(kind, gram, quote_id, needle): a row for each quote that isn't blank."""
    rows = quotes.select("quote_id", fold_citation(F.col("quote")).alias("needle")).where("needle <> ''")
    grams = rows.select("quote_id", "needle", quote_grams(F.col("needle")).alias("g")).select("quote_id", "needle", "g.kind", F.explode(F.array_distinct("g.grams")).alias("gram"))
    shared = grams.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    own = grams.join(shared, ["kind", "gram"])
    return own.groupBy("quote_id", "needle", "kind").agg(F.min(F.struct("n", "gram")).alias("g")).select("kind", "g.gram", "quote_id", "needle")


def text_grams(folded: Column, kind: str) -> Column:
    of = _words if kind[0] == "w" else _characters
    return F.array_distinct(_runs(of(folded), int(kind[1:])))


def hits(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quote_id, doc_id and page of every quote (quote_id, quote) that occurs in a text (doc_id, text)."""
    filed = index(quotes)
    kinds = sorted(r["kind"] for r in filed.select("kind").distinct().collect())  # five at most
    if not kinds:
        return filed.join(texts.select("doc_id"), F.lit(False)).select("quote_id", "doc_id", F.lit(0).alias("page"))
    rows = texts.select("doc_id", "text").where("text IS NOT NULL").withColumn("_k", F.xxhash64("doc_id", "text"))
    every = F.array(*[F.struct(F.lit(k).alias("kind"), text_grams(F.col("folded"), k).alias("grams")) for k in kinds])
    probes = rows.select("_k", fold_citation(F.col("text")).alias("folded")).select("_k", F.explode(every).alias("e")).select("_k", "e.kind", F.explode("e.grams").alias("gram"))
    met = probes.join(filed, ["kind", "gram"]).select("_k", "quote_id", "needle").distinct()
    pages = rows.join(met, "_k").select("quote_id", "doc_id", folded_citation_page(F.col("needle"), fold_citation(F.col("text")), F.col("text")).alias("page"))
    return pages.where(F.col("page").isNotNull())
