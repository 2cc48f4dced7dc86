"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source blocks (by hash of the id, so that no source or group of copies fills one). How many rows each block
sends to each part of each shard is drawn first, as a multivariate hypergeometric matrix with exact row and column sums.
Then every block permutes its rows and deals them out by its row of the matrix, and every part permutes what it receives.
The result is a uniform permutation; shard sizes differ by one at most, and slots in a shard are gapless.

Rows may repeat and ids may be null: each row gets a place of its own (which of two equal rows gets which is open). An empty
table gives an empty one. Extra columns are left out by `assign`, except those named in `carry`. Equal texts are not kept
together: a uniform shuffle of exact sizes cannot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a source block or part of a shard; larger only where the matrix would have more than `MOST` rows or columns.
BLOCK, MOST = 50_000, 2_000


def matrix(sources: np.ndarray, targets: np.ndarray, seed: int) -> np.ndarray:
    """Counts with the given row and column sums, distributed as those of a uniform permutation."""
    rng = np.random.default_rng(seed)
    left = targets.astype(np.int64).copy()
    out = np.zeros((len(sources), len(targets)), dtype=np.int64)
    for i, n in enumerate(sources):
        out[i] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= out[i]
    return out


def parts(total: int, shards: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of every part; shards differ by one row at most, and so do the parts of a shard."""
    shard, first, count = [], [], []
    for s in range(shards):
        rows = total // shards + (s < total % shards)
        n = max(1, -(-rows // size))
        sizes = [rows // n + (k < rows % n) for k in range(n)]
        shard += [s] * n
        first += np.concatenate(([0], np.cumsum(sizes)[:-1])).tolist()
        count += sizes
    return np.array(shard), np.array(first), np.array(count)


def assign(rows: DataFrame, shards: int, key: Column, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """Adds shard and slot to every row."""
    total = rows.count()
    size = max(block, -(-total // MOST))
    blocks = max(1, -(-total // size))
    names = rows.columns
    placed = rows.select(
        F.struct(*names).alias("row"), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).alias("source"),
        F.xxhash64(F.lit(seed + 1), key).alias("draw"), F.xxhash64(F.lit(seed + 2), key).alias("redraw"),
    )
    held = {r["source"]: r["n"] for r in placed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sources = np.array([held.get(i, 0) for i in range(blocks)], dtype=np.int64)
    shard, first, count = parts(total, shards, size)
    sends = matrix(sources, count, seed)

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw", kind="stable")
        ends = np.cumsum(sends[int(group["source"].iloc[0])])
        return group.assign(part=np.searchsorted(ends, np.arange(len(group)), side="right")).drop(columns=["source", "draw"])

    schema = placed.select("row", "redraw").schema.add("part", "long")
    sent = placed.groupBy("source").applyInPandas(deal, schema)
    order = Window.partitionBy("part").orderBy("redraw")
    where = [(i, int(s), int(f)) for i, (s, f) in enumerate(zip(shard, first, strict=True))]  # at most MOST + shards rows
    where = rows.sparkSession.createDataFrame(where, "part long, shard int, first long")
    sent = sent.withColumn("at", F.row_number().over(order) - 1).join(F.broadcast(where), "part")
    return sent.select("row.*", "shard", (F.col("first") + F.col("at")).alias("slot"))
