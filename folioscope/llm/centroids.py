"""Exact k-means over integer vectors with Elkan's bounds.

Vectors are packed into blocks, a row each, with what is cached of every vector: its centroid, an upper bound of the
distance to it and a lower bound of that to each centroid. A round is one pass: a task moves the bounds by how far the
centroids went, and calculates only distances that the bounds, or half the distances between centroids, can't rule out.
A pass writes the next generation of blocks to the shared folder with each block's sums, of which only k totals reach the
driver; then the generation before goes. Nothing is shuffled but those partial sums, and a lost executor costs the tasks
that it ran.

Exactness: components are whole numbers, distances are squared in 64-bit integers. Bounds are 32-bit floats, rounded
outwards by a step each time, and a centroid is skipped only if it is strictly farther, so ties are always calculated and
go to the smaller number. The last pass calculates every vector's distance to its centroid.

Defined results: vectors that are null, of another size, or with a null or non-finite component are left out; components
so large that distances could leave 64 bits (2^27 for 64 components) are an error; repeated rows and ids are vectors of their own; a
null id hashes as an empty one; fewer vectors than k are as many centroids; an empty cluster keeps its centroid; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, only, shared_dir
from folioscope.llm.hashing import lean

#: Vectors in a block.
BLOCK = 4096
_STATE = "ids array<bigint>, vectors binary, nearest binary, upper binary, lower binary, sums array<bigint>, calculated bigint"


def above(x: np.ndarray) -> np.ndarray:
    """The next 32-bit floats over x; the step is larger than any rounding error in x."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), 0)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


@dataclass(frozen=True)
class Centroids:
    """Where the centroids are, how far each went (rounded up) and half the distance between any two (rounded down)."""

    at: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray) -> Centroids:
        k = len(at)
        apart = squares(np.repeat(at, k, axis=0), np.tile(at, (k, 1))).reshape(k, k)
        moved = squares(at, before)
        return cls(at, np.where(moved > 0, above(np.sqrt(moved)), 0), below(np.sqrt(apart) / 2))


class Block:
    """Vectors with their cached bounds."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.calculated = vectors, 0
        self.nearest = np.zeros(len(vectors), np.int16)
        self.upper = np.full(len(vectors), np.inf, np.float32)
        self.lower = np.zeros((len(vectors), k), np.float32)

    def assign(self, to: Centroids) -> None:
        k = len(to.at)
        self.upper = np.where(to.moved[self.nearest] > 0, above(self.upper.astype(np.float64) + to.moved[self.nearest]), self.upper)
        self.lower = np.where(to.moved > 0, below(self.lower.astype(np.float64) - to.moved), self.lower)
        others = np.where(np.eye(k, dtype=bool), np.inf, to.half).min(axis=1, initial=np.inf)
        rows = np.flatnonzero(~(self.upper < others[self.nearest]))
        if not len(rows):
            return
        own, nearest = self.vectors[rows], self.nearest[rows].astype(np.int64)
        best = squares(own, to.at[nearest])
        self.calculated += len(rows)
        root = np.sqrt(best)
        upper, lower = above(root), self.lower[rows]
        lower[np.arange(len(rows)), nearest] = below(root)
        for j in range(k):
            at = np.flatnonzero((nearest != j) & ~(upper < lower[:, j]) & ~(upper < to.half[nearest, j]))
            if not len(at):
                continue
            found = squares(own[at], to.at[j])
            self.calculated += len(at)
            root = np.sqrt(found)
            lower[at, j] = below(root)
            closer = (found < best[at]) | ((found == best[at]) & (j < nearest[at]))
            at, found, root = at[closer], found[closer], root[closer]
            best[at], nearest[at], upper[at] = found, j, above(root)
        self.nearest[rows], self.upper[rows], self.lower[rows] = nearest, upper, lower

    def sums(self, k: int) -> np.ndarray:
        """Of each cluster: the sum of its vectors, and their number."""
        out = np.zeros((k, self.vectors.shape[1] + 1), np.int64)
        for j in range(k):
            mine = self.vectors[self.nearest == j]
            out[j, :-1], out[j, -1] = mine.sum(axis=0, dtype=np.int64), len(mine)
        return out


def whole_vectors(embeddings: DataFrame, vec_id: str, embedding: str, size: int, scale: int) -> DataFrame:
    """id and vector (whole numbers) of the rows that are kept."""
    x = F.col("x")
    most = math.isqrt((1 << 62) // size) // 2  # squared distances then fit 64 bits
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = only(embeddings, id=vec_id, x=embedding).select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) <= most, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")))
    return rows.where((F.size("x") == size) & usable).select("id", whole.alias("vector"))


def pack(vectors: DataFrame, size: int, k: int) -> DataFrame:
    """The first generation of blocks, with no centroid calculated yet."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, size)
                yield as_row(part.column(0), Block(values, k), k)

    return vectors.mapInArrow(lean(run), _STATE)


def as_row(ids: pa.Array, block: Block, k: int) -> pa.RecordBatch:
    names = ["ids", "vectors", "nearest", "upper", "lower", "sums", "calculated"]
    raw = [x.tobytes() for x in (block.vectors.astype("<i4"), block.nearest.astype("<i2"), block.upper.astype("<f4"), block.lower.astype("<f4"))]
    offsets = pa.array([0, len(ids)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids), *[pa.array([x], pa.binary()) for x in raw], pa.array([block.sums(k).ravel().tolist()], pa.list_(pa.int64())), pa.array([block.calculated], pa.int64())], names=names)


def read_block(batch: pa.RecordBatch, i: int, size: int, k: int) -> tuple[pa.Array, Block]:
    block = Block.__new__(Block)
    raw = [batch.column(c)[i].as_py() for c in range(1, 5)]
    block.vectors = np.frombuffer(raw[0], "<i4").reshape(-1, size)
    block.nearest, block.upper = np.frombuffer(raw[1], "<i2").copy(), np.frombuffer(raw[2], "<f4").copy()
    block.lower, block.calculated = np.frombuffer(raw[3], "<f4").reshape(-1, k).copy(), batch.column(6)[i].as_py()
    return batch.column(0)[i].values, block


def assigned(state: DataFrame, to: Centroids, size: int) -> DataFrame:
    """The next generation: every vector at its nearest centroid."""
    k = len(to.at)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, block = read_block(batch, i, size, k)
                block.assign(to)
                yield as_row(ids, block, k)

    return state.mapInArrow(lean(run), _STATE)


def totals(state: DataFrame, k: int, size: int) -> np.ndarray:
    """Sums and counts of the clusters: k rows."""
    found = np.zeros(k * (size + 1), object)
    for r in state.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # k * (size + 1) numbers
        found[r["at"]] = r["x"]
    return found.reshape(k, size + 1)


@dataclass(frozen=True)
class Clustering:
    centroids: np.ndarray
    state: DataFrame
    size: int

    def rows(self) -> DataFrame:
        """vec_id, cluster and the exact squared distance of each vector."""
        at, size = self.centroids, self.size

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, block = read_block(batch, i, size, len(at))
                    found = squares(block.vectors, at[block.nearest])
                    yield pa.RecordBatch.from_arrays([ids, pa.array(block.nearest.astype(np.int32)), pa.array(found)], names=["vec_id", "cluster", "distance"])

        return self.state.select("ids", "vectors", "nearest", "upper", "lower", "sums", "calculated").mapInArrow(lean(run), "vec_id bigint, cluster int, distance bigint")


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> Clustering:
    """Rounds of assignment and moved centroids, then a last assignment.

    The first centroids are the k vectors whose ids, hashed with the seed, come first.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, vec_id, embedding, size, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(order, "id", "vector").limit(k).collect()  # k rows
    at = np.array([r["vector"] for r in first], np.int64).reshape(-1, size)
    k = len(at)
    folder, to = None, Centroids.of(at, at)
    state = pack(vectors, size, k)
    for n in range(rounds + 1):
        path = shared_dir(spark)
        assigned(state, to, size).write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if folder:
            discard(spark, folder)
        folder = path
        if n < rounds:
            found = totals(state, k, size)
            moved = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else own for row, own in zip(found, at, strict=True)], np.int64).reshape(k, size)
            to, at = Centroids.of(moved, at), moved
    return Clustering(at, state, size)


def report(embeddings: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256: a row for each vector that is kept."""
    found = cluster(embeddings, **options)
    rows = found.rows()
    own = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    inertia = [own.get(j, 0) for j in range(len(digests))]
    return rows.select("vec_id", "cluster", "distance", of(inertia, "bigint").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
