"""The cosine neighbour graph of documents: each one's k nearest others, exactly.

Vectors are rows (doc_id, term, weight) of unit length with positive weights. The products that an inverted index would make
are counted first, and two ways lead to the same rows.

Few products: no pair is looked at that shares frequent terms alone. A few seeds, the documents with the largest
weights of a document's own heaviest terms, are scored first: their k-th best cosine is a floor under the answer. A
document's terms are then ordered from rare to frequent; those at the frequent end whose largest possible contribution
stays under the floor need no lookup, as a document that shares only such terms can't get into the answer. The rest of the
terms look other documents up in the inverted index, the partial sums plus the most that is missing must reach the floor,
and only for pairs that pass are the frequent terms added.

Many products, as texts share most of their terms: like vectors become one class, classes are dealt into blocks, and each
pair of blocks is one product of matrices in a task, which keeps the best k of each row over all its tiles. That is quadratic in
the classes, as the work is, but nothing is held or shuffled beyond k rows a class and partition of blocks.

Cosines are rounded to six digits before they are ranked; ties go to the smaller id. Documents that share no term are no
neighbours, so a document may have fewer than k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.catalog import top_per_group
from folioscope.operators.joins import attached, row_numbers
from folioscope.sources.scratch import kept

#: Heaviest terms of a document that look for seeds, and how many documents each term offers.
LEAD, CHAMPIONS = 3, 20
#: Digits that count, and what rounding may hide.
DIGITS, SLACK = 6, 2e-6
#: The index is used up to so many products in all and a row.
PRODUCTS, PRODUCTS_A_ROW = 1_000_000, 4
#: Vectors in a block, terms that a product of two blocks takes at once, and columns that give a tile's first floor.
SIZE, WIDTH, FIRST = 1024, 2048, 512


def _products(pairs: DataFrame, own: DataFrame, others: DataFrame) -> DataFrame:
    """(doc_id, other, x): the products of the terms that both documents of a pair have; own: doc_id, term, weight."""
    return pairs.join(own, "doc_id").join(others, ["other", "term"]).select("doc_id", "other", (F.col("weight") * F.col("weight_2")).alias("x"))


def neighbours(weights: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, rank, other, cosine."""
    rows = kept(weights.select("doc_id", "term", "weight"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    made = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("df") * F.col("df")), F.lit(0)).alias("products")).first()
    return (_by_index if made.products <= PRODUCTS + PRODUCTS_A_ROW * made.rows else _by_tiles)(rows, k)


def _vectors(batches: Iterator) -> Iterator:
    """Each document's terms and weights in the terms' order, as bytes, and their digest."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        terms, weights = batch.column("terms"), batch.column("weights")
        ends, t, w = terms.offsets.to_numpy(), terms.flatten().to_numpy(), weights.flatten().to_numpy()
        order = np.lexsort((t, np.repeat(np.arange(len(batch)), np.diff(ends))))
        t, w = t[order].astype(np.int32), w[order].astype(np.float64)
        parts = [(t[a:b].tobytes(), w[a:b].tobytes()) for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
        digests = [hashlib.sha256(a + b).digest() for a, b in parts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array([a for a, _ in parts], pa.binary()), pa.array([b for _, b in parts], pa.binary())], ["doc_id", "digest", "terms", "weights"])


def _packed(block, table):
    """A block as one row: ids, and the entries of its vectors by place, term and weight."""
    import numpy as np
    import pyarrow as pa

    terms, weights = table["terms"].to_pylist(), table["weights"].to_pylist()
    places = np.repeat(np.arange(len(table), dtype=np.int32), [len(t) // 4 for t in terms])
    parts = {"ids": table["id"].to_numpy().tobytes(), "places": places.tobytes(), "terms": b"".join(terms), "weights": b"".join(weights)}
    return pa.table({"block": pa.array([block[0].as_py()], pa.int64())} | {c: pa.array([x], pa.binary()) for c, x in parts.items()})


def _tiles(k: int, width: int, first: int) -> Callable[[Iterator], Iterator]:
    """The best k of each vector over the tiles of a task, from pairs of blocks: id, other, cosine."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        unit = 10.0**DIGITS
        best = {}  # block: ids, and the best rows so far as places, cosines and others, sorted

        def block(row, side):
            kinds = (("ids", np.int64), ("places", np.int32), ("terms", np.int32), ("weights", np.float64))
            return [np.frombuffer(row[f"{c}_{side}"].as_py(), kind) for c, kind in kinds]

        def dense(vectors, own):
            ids, places, terms, weights = vectors
            column = np.minimum(np.searchsorted(own, terms), len(own) - 1)
            held = own[column] == terms
            full = np.zeros((len(ids), len(own)))
            full[places[held], column[held]] = weights[held]
            return full

        def offer(number, ids, others, x):
            """Adds the columns of x to the best of its rows."""
            _, places, cosines, known = best.setdefault(number, (ids, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
            floor = np.full(len(ids), 0.5 / unit)
            full = np.bincount(places, minlength=len(ids)) == k
            floor[full] = np.maximum(cosines[np.searchsorted(places, np.flatnonzero(full), "right") - 1] - 1 / unit, floor[full])
            if not full.all() and x.shape[1] >= k:
                some = x[~full, : max(first, k)]
                floor[~full] = np.maximum(floor[~full], np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - 1 / unit)
            r, c = np.nonzero(x >= floor[:, None])
            places, cosines, known = np.concatenate([places, r]), np.concatenate([cosines, np.floor(x[r, c] * unit + 0.5) / unit]), np.concatenate([known, others[c]])
            order = np.lexsort((known, -cosines, places))
            starts = np.searchsorted(places[order], np.arange(len(ids)))
            order = order[np.arange(len(order)) - starts[places[order]] < k]
            best[number] = (ids, places[order], cosines[order], known[order])

        seen = None  # pairs of one left block follow each other
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in batch.schema.names}
                i, j, b = row["block_a"].as_py(), row["block_b"].as_py(), block(row, "b")
                if i != seen:
                    a, seen = block(row, "a"), i
                    own = np.unique(a[2])
                    left = dense(a, own) if len(own) <= width else None
                x = left @ dense(b, own).T if left is not None else sum(dense(a, own[at : at + width]) @ dense(b, own[at : at + width]).T for at in range(0, len(own), width))
                if i == j:
                    np.fill_diagonal(x, -1)
                else:
                    offer(j, b[0], a[0], x.T)
                offer(i, a[0], b[0], x)
            batch = row = None  # else it stays while the next one is read
        for ids, places, cosines, known in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[places]), pa.array(known), pa.array(cosines)], ["id", "other", "cosine"])

    return run


def _by_tiles(rows: DataFrame, k: int) -> DataFrame:
    numbers = row_numbers(rows.select("term").distinct(), ["term"], "t")
    entries = rows.join(numbers, "term").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), "weight")).alias("v"))  # a document's terms
    vectors = kept(entries.select("doc_id", F.col("v.t").alias("terms"), F.col("v.weight").alias("weights")).mapInArrow(_vectors, "doc_id long, digest binary, terms binary, weights binary"))
    classes = kept(vectors.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    members = kept(attached(vectors.select("doc_id", "digest"), classes, ["digest"], "n").select("doc_id", "id"))

    lone = vectors.join(classes.select("id"), F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "terms", "weights")
    dealt = lone.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(-(-classes.count() // SIZE) or 1)))
    blocks = kept(dealt.groupBy("block").applyInArrow(_packed, "block long, ids binary, places binary, terms binary, weights binary"))
    a, b = (blocks.select([F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "ab")
    pairs = a.join(b.hint("shuffle_replicate_nl"), F.col("block_a") <= F.col("block_b"))  # a few rows of some MB, each pair once
    found = pairs.mapInArrow(_tiles(k, WIDTH, FIRST), "id long, other long, cosine double")
    best = top_per_group(found, ["id"], [F.desc("cosine"), F.asc("other")], k).select("id", "other", "cosine")

    # a class is as near as each of its members, of which the first k + 1 may count
    near = kept(best.unionByName(classes.select("id", F.col("id").alias("other"), F.lit(1.0).alias("cosine"))))
    firsts = top_per_group(members, ["id"], [F.asc("doc_id")], k + 1).groupBy("id").agg(F.collect_list("doc_id").alias("docs"))  # k + 1 at most
    named = near.groupBy("other").agg(F.count("*").alias("_named"))
    each = attached(near, firsts.withColumnRenamed("id", "other").join(named, "other"), ["other"], "_named").select("id", F.explode("docs").alias("other"), "cosine")
    lists = top_per_group(each, ["id"], [F.desc("cosine"), F.asc("other")], k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "other"))).alias("near"))  # k + 1 at most
    listed = attached(members, kept(lists.join(classes.select("id", "n"), "id")), ["id"], "n")
    others = F.slice(F.filter("near", lambda o: o["other"] != F.col("doc_id")), 1, k)
    return listed.select("doc_id", F.posexplode(others).alias("place", "o")).select("doc_id", (F.col("place") + 1).alias("rank"), "o.other", (-F.col("o.far")).alias("cosine"))


def _by_index(rows: DataFrame, k: int) -> DataFrame:
    others = rows.select(F.col("doc_id").alias("other"), "term", F.col("weight").alias("weight_2"))
    apart = F.col("doc_id") != F.col("other")

    lead = top_per_group(rows, ["doc_id"], [F.desc("weight"), F.asc("term")], LEAD).select("doc_id", "term")
    champions = top_per_group(others, ["term"], [F.desc("weight_2"), F.asc("other")], CHAMPIONS).select("other", "term")
    seeds = lead.join(champions, "term").where(apart).select("doc_id", "other").distinct()
    scored = _products(seeds, rows, others).groupBy("doc_id", "other").agg(F.sum("x").alias("cosine"))
    best = top_per_group(scored, ["doc_id"], [F.desc("cosine")], k)
    floor = best.groupBy("doc_id").agg(F.when(F.count("*") == k, F.min("cosine")).otherwise(0.0).alias("floor"))

    terms = rows.groupBy("term").agg(F.max("weight").alias("most"), F.count("*").alias("df"))
    frequent_first = Window.partitionBy("doc_id").orderBy(F.desc("df"), "term")
    bound = F.least(F.sum(F.col("weight") * F.col("most")).over(frequent_first), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(frequent_first)))
    placed = rows.join(terms, "term").withColumn("bound", bound).join(floor, "doc_id", "left").select("doc_id", "term", "weight", "bound", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    marked = kept(placed.withColumn("looks", F.col("bound") >= F.col("floor") - SLACK))

    missing = marked.groupBy("doc_id").agg(F.max(F.when(~F.col("looks"), F.col("bound"))).alias("missing"), F.first("floor").alias("floor"))
    met = marked.where("looks").join(others, "term").where(apart).groupBy("doc_id", "other").agg(F.sum(F.col("weight") * F.col("weight_2")).alias("x"))
    passed = kept(met.join(missing, "doc_id").where(F.col("x") + F.coalesce("missing", F.lit(0.0)) >= F.col("floor") - SLACK).select("doc_id", "other", "x"))
    added = _products(passed.select("doc_id", "other"), marked.where("NOT looks").select("doc_id", "term", "weight"), others)
    cosine = F.round(F.sum("x"), DIGITS)
    every = passed.unionByName(added).groupBy("doc_id", "other").agg(cosine.alias("cosine")).where("cosine > 0")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("cosine"), "other"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("doc_id", "rank", "other", "cosine")
