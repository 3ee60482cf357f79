"""Text mining over a corpus DataFrame (doc_id, text and group columns): terms, concordance, co-occurrence, signals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.dictionaries import CONNECTIVES
from folioscope.functions.text import clean, collapse, fold_light, let, ngrams, occurrences, python_fold, tokens, without_words
from folioscope.operators.catalog import top_per_group
from folioscope.sources.scratch import kept


def _terms(text: Column, ngram: tuple[int, int], stopwords: Sequence[str], connectives: Sequence[str]) -> Column:
    # a term has a digit if one of its tokens has: each token is looked at once, and such ones become a mark
    marked = F.transform(without_words(tokens(clean(text, connectives)), stopwords), lambda t: F.when(t.rlike(r"\p{Nd}"), F.lit("\0")).otherwise(t))
    return F.filter(ngrams(marked, *ngram), lambda t: ~F.contains(t, F.lit("\0")))


def term_frequency(corpus: DataFrame, ngram: tuple[int, int] = (1, 1), min_freq: int = 2, stopwords: Sequence[str] = (), connectives: Sequence[str] = CONNECTIVES, by: Sequence[str] = ()) -> DataFrame:
    """How often each term occurs; n-grams run over the tokens left after stopwords; terms with digits are out."""
    rows = corpus.select(*by, F.explode(_terms(F.col("text"), ngram, stopwords, connectives)).alias("term"))
    return rows.groupBy(*by, "term").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)


def top_terms(freq: DataFrame, n: int) -> DataFrame:
    """Ties go by term."""
    return freq.orderBy(F.desc("freq"), "term").limit(n)


def term_lookup(freq: DataFrame, term: str, ngram: tuple[int, int]) -> DataFrame:
    """The row of one exact term; none if its number of words is out of range."""
    wanted = " ".join(term.lower().split())
    return freq.where(F.col("term") == wanted) if ngram[0] <= len(wanted.split()) <= ngram[1] else freq.limit(0)


def term_heatmap(corpus: DataFrame, by: str, n: int = 20, **options) -> DataFrame:
    """The n top terms of the whole corpus, counted per value of a column, with zeros."""
    per = term_frequency(corpus.where(F.col(by).isNotNull()), min_freq=1, by=[by], **options)
    top = top_terms(per.groupBy("term").agg(F.sum("freq").alias("freq")).where("freq >= 2"), n).select("term")
    values = corpus.where(F.col(by).isNotNull()).select(by).distinct()
    grid = F.broadcast(top).crossJoin(values)  # n terms by the column's values
    return grid.join(per, [by, "term"], "left").select(by, "term", F.coalesce("freq", F.lit(0)).alias("freq"))


def top_terms_by(corpus: DataFrame, by: str, n: int = 15, **options) -> DataFrame:
    """Top terms of each group, in one grouped query."""
    return top_per_group(term_frequency(corpus, by=[by], **options), [by], [F.desc("freq"), F.asc("term")], n)


def concordance(corpus: DataFrame, term: str, context: int = 50, limit: int | None = 100) -> DataFrame:
    """Every occurrence, overlapping ones too, in its context; accent-sensitive substring search."""
    wanted = term.lower().strip()
    text = collapse(F.lower("text"))
    rows = corpus.select("doc_id", text.alias("t")).where(F.contains("t", F.lit(wanted)))
    hits = rows.select("doc_id", "t", F.explode(occurrences(F.col("t"), wanted)).alias("pos"))
    size = len(wanted)
    left = F.substr("t", F.greatest(F.col("pos") - context, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(context)))
    right = F.substr("t", F.col("pos") + size + 1, F.lit(context))
    found = hits.select("doc_id", F.col("pos").alias("posicao"), F.concat(left, F.lit(f"**{wanted}**"), right).alias("trecho")).orderBy("doc_id", "posicao")
    return found if limit is None else found.limit(limit)


def cooccurrence(corpus: DataFrame, vocabulary: Sequence[str], window: int = 10, min_freq: int = 2) -> DataFrame:
    """Unordered pairs of vocabulary words at most window kept words apart. Words are split at white space only.

    Kept words are numbered inside the document's array, and each is paired with the next few of the same array: no
    shuffle but that of the pair counts.
    """
    wanted = F.array(*[F.lit(w) for w in vocabulary])
    kept = F.filter(F.split(collapse(F.lower("text")), " "), lambda w: F.array_contains(wanted, w))
    rows = corpus.select(kept.alias("w"))
    near = lambda w, i: F.transform(F.filter(F.slice(F.col("w"), i + 2, window), lambda x: x != w), lambda x: F.struct(F.least(w, x).alias("t1"), F.greatest(w, x).alias("t2")))
    pairs = rows.select(F.explode(F.flatten(F.transform("w", near))).alias("p")).select("p.t1", "p.t2")
    return pairs.groupBy("t1", "t2").agg(F.count("*").alias("n")).where(F.col("n") >= min_freq)


def cooccurrence_matrix(pairs: DataFrame) -> DataFrame:
    """Both directions, for a sparse view."""
    return pairs.unionByName(pairs.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "n"))


#: Counters of a sketch of one partition.
COUNTERS = 4096


def sketched(counts: dict[str, int], capacity: int) -> tuple[dict[str, int], int]:
    """A summary of heavy hitters: at most capacity counters, and by how much they may be too low."""
    if len(counts) <= capacity:
        return counts, 0
    cut = sorted(counts.values(), reverse=True)[capacity]
    return {t: n - cut for t, n in counts.items() if n > cut}, cut


def heavy_terms(corpus: DataFrame, n: int, min_freq: int = 2, stopwords: Sequence[str] = (), connectives: Sequence[str] = CONNECTIVES, capacity: int = COUNTERS) -> DataFrame:
    """The n top words of the corpus (ties by word), without a shuffle of the whole vocabulary.

    Each partition keeps a bounded sketch, the sketches are merged by word, and only words whose count can reach the n-th
    best lower bound are counted exactly. Where the bounds can't tell, the sketches get eight times the counters, at last
    one for each word.
    """
    words = corpus.select(_terms(F.col("text"), (1, 1), stopwords, connectives).alias("words"))

    def sketch(size: int):
        def run(batches):
            counts: dict[str, int] = {}
            low = 0
            for batch in batches:
                for found in batch.column(0).to_pylist():
                    for w in found or ():
                        counts[w] = counts.get(w, 0) + 1
                    if len(counts) > 2 * size:
                        counts, cut = sketched(counts, size)
                        low += cut
            counts, cut = sketched(counts, size)
            yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), low + cut], pa.int64())], names=["term", "n"])

        return run

    while True:
        merged = kept(words.mapInArrow(sketch(capacity), "term string, n long").groupBy("term").agg(F.sum("n").alias("low")))
        error = merged.where("term IS NULL").agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
        best = [r["low"] for r in merged.where("term IS NOT NULL").orderBy(F.desc("low")).limit(n).collect()]
        if not error or (len(best) == n and best[-1] > error):
            break
        capacity *= 8
    least = best[-1] - error if len(best) == n else 0
    candidates = merged.where(F.col("term").isNotNull() & (F.col("low") >= least)).select("term")
    exact = words.select(F.explode("words").alias("term")).join(candidates, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))
    return top_terms(exact.where(F.col("freq") >= min_freq), n)


def window_matrix(corpus: DataFrame, top_n: int = 30, window: int = 10, min_freq: int = 2, **options) -> DataFrame:
    """The top words' co-occurrences as a dense matrix in rows t1, t2, n, with zeros; top_n squared rows."""
    spark = corpus.sparkSession
    vocabulary = sorted(r["term"] for r in heavy_terms(corpus, top_n, min_freq, **options).collect())  # top_n words
    axis = lambda name: spark.createDataFrame([(w,) for w in vocabulary], f"{name} string")
    pairs = cooccurrence_matrix(cooccurrence(corpus, vocabulary, window, min_freq)) if vocabulary else spark.createDataFrame([], "t1 string, t2 string, n long")
    return axis("t1").crossJoin(axis("t2")).join(pairs, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("n", F.lit(0)).alias("n"))  # top_n squared


def signal_pattern(signal: str, bigrams: bool = True) -> str:
    """The signal as whole words, or (several words) any two neighbours of it."""
    words = [re.escape(w) for w in python_fold(signal).split()]
    runs = [words] + ([words[i : i + 2] for i in range(len(words) - 1)] if bigrams and len(words) > 1 else [])
    return r"(?U)\b(?:" + "|".join(r"\s+".join(r) for r in runs) + r")\b"


def near_signal(text: Column, signal: str, bigrams: bool = True) -> Column:
    """Whether a collapsed text holds the signal, or two neighbours of it, at all."""
    words = python_fold(signal).split()
    runs = [" ".join(words)] + ([" ".join(words[i : i + 2]) for i in range(len(words) - 1)] if bigrams and len(words) > 1 else [])
    found = F.contains(text, F.lit(runs[0]))
    for r in runs[1:]:
        found = found | F.contains(text, F.lit(r))
    return found


def signals(corpus: DataFrame, dimensions: dict[str, Sequence[str]], bigrams: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """For each document and dimension the signals present, with rows of none. One literal pattern a signal."""
    rows = corpus.select("doc_id", *by, fold_light(F.coalesce("text", F.lit(""))).alias("t"))
    # plain search spares most texts the pattern
    present = lambda own: F.array_compact(F.array(*[F.when(near_signal(F.col("t"), s, bigrams) & F.col("t").rlike(signal_pattern(s, bigrams)), F.lit(s)) for s in own]))
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), present(own).alias("found")) for d, own in dimensions.items()])
    found = rows.select("doc_id", *by, F.explode(each).alias("d"))
    return found.select("doc_id", *by, "d.dimension", F.size("d.found").alias("n"), F.array_join("d.found", ", ").alias("sinais"))


def prevalence(mined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of documents with a signal, by dimension and groups."""
    return mined.groupBy(*by, "dimension").agg(F.round(F.avg(F.when(F.col("n") > 0, 100.0).otherwise(0.0)), 1).alias("pct"), F.count("*").alias("n_docs"))


def signal_hits(corpus: DataFrame, terms: Sequence[str], by: str, cap: int = 500) -> DataFrame:
    """Occurrences of each signal by group, at most cap of each signal in document order (the report's feature)."""
    wanted = [t.lower().strip() for t in terms]
    text = collapse(F.lower("text"))
    each = lambda t: F.array(*[F.struct(F.lit(name).alias("signal"), F.when(F.contains(t, F.lit(w)), occurrences(t, w)).otherwise(F.array().cast("array<int>")).alias("at")) for name, w in zip(terms, wanted, strict=True)])
    found = corpus.select("doc_id", by, F.explode(let(text, each)).alias("s")).select("doc_id", by, "s.signal", F.explode("s.at").alias("at"))
    return top_per_group(found, ["signal"], [F.asc("doc_id"), F.asc("at")], cap).groupBy("signal", by).agg(F.count("*").alias("n"))


def search(corpus: DataFrame, term: str) -> DataFrame:
    """F12."""
    return corpus.where(F.contains(F.lower("text"), F.lit(term.lower())))


def sample(corpus: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N documents without replacement, the same ones for the same seed."""
    return corpus.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), "doc_id").limit(n)


def tfidf(corpus: DataFrame, max_features: int = 1500, min_df: int = 2, max_df: float = 0.9, stopwords: Sequence[str] = (), connectives: Sequence[str] = CONNECTIVES) -> DataFrame:
    """doc_id, term, weight = tf * (ln((1 + n) / (1 + df)) + 1), of unit length by document.

    Relational: document frequencies are counts over (document, term) rows, the vocabulary is a bounded top list.
    """
    rows = corpus.select("doc_id", F.explode(_terms(F.col("text"), (1, 1), stopwords, connectives)).alias("term"))
    tf = kept(rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    total = corpus.agg(F.countDistinct("doc_id").alias("docs"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all_tf")).join(F.broadcast(total)).where((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * max_df))  # total is one row
    vocabulary = stats.orderBy(F.desc("all_tf"), "term").limit(max_features).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf"))  # at most max_features rows
    vectors = weighted.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))  # max_features at most
    # summed in the terms' order, so like documents have like weights to the last bit; once a document, not once a term
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    scaled = let(norm, lambda n: F.transform("v", lambda x: F.struct(x["term"].alias("term"), (x["w"] / n).alias("weight"))))
    return vectors.select("doc_id", F.explode(scaled).alias("x")).select("doc_id", "x.term", "x.weight")


#: Documents whose vectors are multiplied at once, and rows of the products that are added up together.
BATCH, ROWS = 1024, 16


def _gram(n_terms: int, batch_size: int, rows: int) -> Callable[[Iterator], Iterator]:
    """Of a task's vectors: how many, the sum of each term's weights and the products of all pairs of terms, in blocks of rows."""

    def run(batches):
        import numpy as np
    
        gram, sums, docs = np.zeros((n_terms, n_terms)), np.zeros(n_terms), 0
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                some = batch.slice(at, batch_size)
                k, w = some.column("k"), some.column("weight").flatten().to_numpy()
                full = np.zeros((len(some), n_terms))
                full[np.repeat(np.arange(len(some)), np.diff(k.offsets.to_numpy())), k.flatten().to_numpy()] = w
                gram += full.T @ full
                sums += full.sum(axis=0)
                docs += len(some)
        if docs:
            first = range(0, n_terms, rows)
            columns = [pa.array(first, pa.int32()), pa.array([docs] * len(first), pa.int64()), *(pa.array([x[i : i + rows].tobytes() for i in first], pa.binary()) for x in (sums, gram))]
            yield pa.RecordBatch.from_arrays(columns, ["first", "docs", "sums", "products"])

    return run


def _added(first, table):
    """The tasks' parts of one block of rows, added up."""
    import numpy as np

    total = {c: sum(np.frombuffer(x.as_buffer()) for x in table[c]).tobytes() for c in ("sums", "products")}
    return pa.table({"first": pa.array([first[0].as_py()], pa.int32()), "docs": pa.array([sum(table["docs"].to_pylist())], pa.int64())} | {c: pa.array([x], pa.binary()) for c, x in total.items()})


def project_2d(weights: DataFrame) -> DataFrame:
    """Documents in two dimensions by PCA over sparse vectors (doc_id, term, weight), in place of a neighbour embedding.

    Each task multiplies its documents' vectors as matrices, and the tasks' products are added up into one number a pair of
    terms: that table, bounded by the vocabulary's square, is all that reaches the driver, and the two axes, a number a term,
    are what goes back. Each axis points to where its largest loading is positive; documents aren't centred.
    """
    import numpy as np

    spark, weights = weights.sparkSession, kept(weights.select("doc_id", "term", "weight"))
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]  # the vocabulary
    rows = weights.join(F.broadcast(spark.createDataFrame(list(enumerate(terms)), "k int, term string")), "term").select("doc_id", "k", "weight")
    vectors = rows.groupBy("doc_id").agg(F.collect_list(F.struct("k", "weight")).alias("v")).select(F.col("v.k").alias("k"), F.col("v.weight").alias("weight"))  # a document's terms
    parts = vectors.mapInArrow(_gram(len(terms), BATCH, ROWS), "first int, docs long, sums binary, products binary")
    found = parts.groupBy("first").applyInArrow(_added, "first int, docs long, sums binary, products binary").toArrow().to_pylist()
    n = found[0]["docs"] if found else 0
    gram, mean = np.zeros((len(terms), len(terms))), np.zeros(len(terms))
    for part in found:
        block = np.frombuffer(part["products"]).reshape(-1, len(terms))
        gram[part["first"] : part["first"] + len(block)] = block
        mean[part["first"] : part["first"] + len(block)] = np.frombuffer(part["sums"]) / max(n, 1)
    axes = np.linalg.eigh(gram - n * np.outer(mean, mean))[1][:, ::-1][:, :2] if len(terms) else np.zeros((0, 2))
    axes = np.pad(axes, ((0, 0), (0, 2 - axes.shape[1])))
    if len(terms):
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1, 1)
    sent = F.broadcast(spark.createDataFrame([(k, *map(float, axis)) for k, axis in enumerate(axes)], "k int, x double, y double"))  # a row a term
    return rows.join(sent, "k").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("x")).alias("x"), F.sum(F.col("weight") * F.col("y")).alias("y"))
