"""Centroid clustering with bounds that a cluster's sphere keeps tight: few vectors are compared with all centroids.

Vectors are integers, so distances, sums and centroids are exact. Each vector keeps an upper bound of the distance to its own
centroid and a lower bound of that to every other one. When centroids move, the upper bound grows by the own centroid's move.
The lower bound need not shrink by the largest move of another centroid: all vectors of a cluster lie in a sphere around its
old centroid, and from there a centroid that moves sideways or away comes nearer by less than its move. In the plane through
the sphere's middle and the old and new place of the other centroid, let p be the point half way between these places. From p
the sphere is seen within an angle asin(radius / distance) around its middle; no vector gets nearer by more than the move times
the cosine of its angle at p to the move (see `nearing`). Vectors whose bounds meet are ambiguous and scanned exactly.

Vectors lie in blocks of `BLOCK`, kept in partitions by block; their bounds are a table of their own, about a seventh of the
size, written in every round and joined block by block, so that vectors are never shuffled or written again. A block none
of whose vectors can be ambiguous doesn't send its vectors to the scan. Centroid sums change by the vectors that changed their
cluster; the driver sees sums and radii of the clusters and nothing else, whatever the number or the sameness of the vectors.

Vectors that are null, of another length, or with a null or non-finite component are left out. Rows may repeat and ids may be
null; first centroids are those of the smallest id hashes (null ids last, ties by components). With fewer vectors than centroids
there are fewer centroids, and an empty table gives an empty one. Equal distances go to the smaller number; a centroid without
vectors stays. Components of 2^17 or more in size would overflow squared distances and raise an error. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.llm.common import settle

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors of a block, and components below which squared distances of 64 of them fit 63 bits.
BLOCK, LARGEST = 4096, 1 << 27
#: Bounds are held in single precision and loosened by this share whenever they are written.
LOOSE = 1e-6


def integers(values: np.ndarray) -> np.ndarray:
    x = np.floor(values.astype(np.float64) * SCALE)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE} in size")
    return x.astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """The numbers in the fewest of 2 or 4 bytes that hold them all."""
    small = not x.size or (x.min() >= -(1 << 15) and x.max() < 1 << 15)
    return x.astype("<i2" if small else "<i4").tobytes()


def unpacked(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i2" if len(data) == 2 * rows * dims else "<i4").reshape(rows, dims)


def blocks_of(vectors: DataFrame, vec_id: str, embedding: str, dims: int, block: int) -> DataFrame:
    """(block, ids, vectors): a row for up to `block` vectors, as integers."""
    x = F.col(embedding)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(x.isNotNull() & (F.size(x) == dims)).filter(whole).select(F.col(vec_id).alias("vec_id"), x.alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size, number = TaskContext.get().partitionId() << 32, [], 0, 0

        def told() -> pa.RecordBatch:
            ids = pa.concat_arrays([i for i, _ in held])
            data = packed(np.concatenate([v for _, v in held]))
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([first | number]), lists, pa.array([data], pa.binary())], ["block", "ids", "vectors"])

        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                if held and size + part.num_rows > block:
                    yield told()
                    held, size, number = [], 0, number + 1
                values = part.column(1).flatten().to_numpy(zero_copy_only=False)
                held.append((part.column(0), integers(values).reshape(-1, dims)))
                size += part.num_rows
        if held:
            yield told()

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, vectors binary").withColumn("n", F.size("ids"))


def nearing(ball: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """The most by which any point of the ball is nearer to `new` than to `old`; an upper bound.

    For a point x and p half way, |x-old| - |x-new| = 2 (x-p).(new-old) / (|x-old| + |x-new|), and the two distances add up to
    2 |x-p| or more. So it is at most |new-old| times the cosine of the angle at p between x and the move, or 0 beyond a right angle.
    """
    move = new - old
    size = float(np.linalg.norm(move))
    if not size:
        return 0.0
    to = ball - (old + new) / 2
    far = float(np.linalg.norm(to))
    if far <= radius:
        return size
    middle = float(np.arccos(np.clip(to @ move / (far * size), -1, 1)))
    return size * max(0.0, float(np.cos(max(0.0, middle - float(np.arcsin(radius / far)) - 1e-7))))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cluster: how far its centroid moved, by how much any other one came nearer, and half way to the nearest other one."""
    k = len(old)
    moved = np.linalg.norm(new - old, axis=1)
    near = np.array([max((nearing(old[i], radius[i], old[j], new[j]) for j in range(k) if j != i), default=0.0) for i in range(k)])
    apart = np.array([min((np.linalg.norm(new[i] - new[j]) for j in range(k) if j != i), default=np.inf) for i in range(k)])
    return moved, near, apart / 2


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k) squared distances, exact: in doubles where every sum stays below 2^53, else in integers."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * largest**2 < 1 << 53:
        x, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals), bounds of the distance to it and to the next one."""
    d = squared(x, centroids)
    own, rows = d.argmin(axis=1), np.arange(len(d))
    upper = np.sqrt(d[rows, own].astype(np.float64))
    if d.shape[1] == 1:
        return own, upper, np.full(len(d), np.inf)
    d[rows, own] = np.iinfo(np.int64).max
    return own, upper, np.sqrt(d.min(axis=1).astype(np.float64))


def assign(blocks: DataFrame, state: DataFrame | None, old: np.ndarray | None, new: np.ndarray, radius: np.ndarray | None) -> DataFrame:
    """(block, cluster, upper, lower, slack, changes, radius) of every block: bounds of its vectors, and the changes of cluster sums."""
    k, dims = new.shape
    names = ["block", "cluster", "upper", "lower", "slack", "changes", "radius", "scanned"]
    schema = "block long, cluster binary, upper binary, lower binary, slack double, changes array<long>, radius array<double>, scanned long"
    if state is None:
        rows = blocks.select("block", "n", "vectors", *[F.lit(None).cast("binary").alias(c) for c in ("cluster", "upper", "lower")])
        moved = near = half = np.zeros(k)
    else:
        moved, near, half = loosening(old.astype(np.float64), new.astype(np.float64), radius)
        # What a block's vectors may lose: beyond its slack some may be ambiguous, and only then it is read.
        worst = float((moved + near).max())
        rows = blocks.select("block", "n", "vectors").join(state.select("block", "cluster", "upper", "lower", "slack"), "block")
        rows = rows.withColumn("vectors", F.when(F.col("slack") <= F.lit(worst), F.col("vectors"))).select("block", "n", "vectors", "cluster", "upper", "lower")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, data, *held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                changes, scanned = np.zeros((k, dims + 1), dtype=np.int64), 0
                if held[0] is None:
                    x = unpacked(data, n, dims)
                    own, upper, lower = scan(x, new)
                    scanned = len(x)
                    add(changes, own, x, 1)
                else:
                    own = np.frombuffer(held[0], dtype="<i2").astype(np.int64)
                    upper = np.frombuffer(held[1], dtype="<f4") + moved[own]
                    lower = np.maximum(np.frombuffer(held[2], dtype="<f4") - near[own], 0)
                    if data is not None:
                        x = unpacked(data, n, dims)
                        at = np.flatnonzero(upper * (1 + LOOSE) >= np.maximum(lower, half[own]) * (1 - LOOSE))
                        # The bound of the own distance first, as it may do.
                        d = x[at].astype(np.float64) - new[own[at]]
                        upper[at] = np.sqrt((d * d).sum(axis=1))
                        at = at[upper[at] * (1 + LOOSE) >= np.maximum(lower[at], half[own[at]]) * (1 - LOOSE)]
                        scanned = len(at)
                        now, upper[at], lower[at] = scan(x[at], new)
                        other = now != own[at]
                        add(changes, own[at][other], x[at][other], -1)
                        add(changes, now[other], x[at][other], 1)
                        own[at] = now
                upper, lower = (upper * (1 + LOOSE)).astype("<f4"), (lower * (1 - LOOSE)).astype("<f4")
                wide = np.zeros(k)
                np.maximum.at(wide, own, upper)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([own.astype("<i2").tobytes()], pa.binary()), pa.array([upper.tobytes()], pa.binary()),
                    pa.array([lower.tobytes()], pa.binary()), pa.array([float(((lower - upper) * (1 - LOOSE) - 3 * LOOSE * upper).min())]),
                    pa.array([changes.ravel().tolist() if changes.any() else None], pa.list_(pa.int64())),
                    pa.array([wide.tolist()], pa.list_(pa.float64())), pa.array([scanned]),
                ], names)

    return rows.mapInArrow(run, schema)


def add(changes: np.ndarray, own: np.ndarray, x: np.ndarray, sign: int) -> None:
    """Add or take the vectors and their number to or from the sums of their clusters."""
    for i in np.unique(own):
        mine = x[own == i]
        changes[i, :-1] += sign * mine.sum(axis=0, dtype=np.int64)
        changes[i, -1] += sign * len(mine)


def totals(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes of sums and counts as whole numbers of any size, and the radius of every cluster's sphere: k rows of dims + 2 numbers."""
    sums = state.select(F.posexplode("changes").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    wide = state.select(F.posexplode("radius").alias("at", "x")).groupBy("at").agg(F.max("x").alias("x")).collect()
    changes, radius = np.zeros(k * (dims + 1), dtype=object), np.zeros(k)
    for r in sums:
        changes[r["at"]] = int(r["x"])
    for r in wide:
        radius[r["at"]] = r["x"]
    return changes.reshape(k, dims + 1), radius


def first_centroids(blocks: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order; of each block, k at most come to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = unpacked(data, n, dims)
                digest = ["~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
                last = sorted(digest)[: k][-1]
                best = sorted((d, x[i].tolist()) for i, d in enumerate(digest) if d <= last)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in best]), pa.array([v for _, v in best], pa.list_(pa.int64()))], ["h", "x"])

    found = blocks.select("ids", "n", "vectors").mapInArrow(run, "h string, x array<long>")
    return np.array([r["x"] for r in found.orderBy("h", "x").limit(k).collect()], dtype=np.int64).reshape(-1, dims)


def distances(blocks: DataFrame, state: DataFrame, centroids: np.ndarray, schema: str) -> DataFrame:
    """(vec_id, cluster, distance) of every vector, the distance squared and exact."""
    dims = centroids.shape[1]
    rows = blocks.select("block", "ids", "n", "vectors").join(state.select("block", "cluster"), "block").select("ids", "n", "vectors", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, data, held = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                own = np.frombuffer(held, dtype="<i2")
                difference = unpacked(data, n, dims).astype(np.int64) - centroids[own]
                cols = [batch.column(0)[i].values, pa.array(own.astype(np.int32)), pa.array((difference * difference).sum(axis=1))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, schema)


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding",
    block: int = BLOCK, scanned: list[int] | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, and the final centroids. `scanned` gets how many vectors each round compared with all centroids."""
    spark = vectors.sparkSession
    written = settle(blocks_of(vectors, vec_id, embedding, dims, block), "drift-blocks")
    kind = f"vec_id {written.schema['ids'].dataType.elementType.simpleString()}, cluster int, distance long"
    centroids = first_centroids(written, k, dims, seed)
    if not len(centroids):
        return spark.createDataFrame([], kind), centroids
    k = len(centroids)
    # Some 128 MB in a partition; a lost one is read again from the written table.
    partitions = max(spark.sparkContext.defaultParallelism, written.count() // 256)
    blocks = written.repartition(partitions, "block").persist(StorageLevel.DISK_ONLY)
    sums, state, old, radius = np.zeros((k, dims + 1), dtype=object), None, None, None
    for turn in range(rounds + 1):
        state = settle(assign(blocks, state, old, centroids, radius), f"drift-state-{turn}")
        changes, radius = totals(state, k, dims)
        if scanned is not None:
            scanned.append(state.agg(F.sum("scanned")).first()[0])
        if turn < rounds:
            sums = sums + changes
            old, centroids = centroids, np.array(
                [[s // row[-1] for s in row[:-1]] if row[-1] else list(c) for row, c in zip(sums.tolist(), centroids.tolist(), strict=True)], dtype=np.int64)
    found = settle(distances(blocks, state, centroids, kind), "drift-distances")
    blocks.unpersist()
    return found, centroids


def digest_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256."""
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # one row a centroid
    sums = {r["cluster"]: int(r["s"]) for r in sums}
    told = [(i, sums.get(i, 0), sum(sums.values()), digest_of(c)) for i, c in enumerate(centroids)]
    told = found.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
