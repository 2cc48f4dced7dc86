"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling.

Documents fall into cells by source, language and topic. Token weights of cells are raked: in turn each dimension's sums are
scaled to its target shares, until all of them agree. Weights are 1 in the mean of the tokens, so a document is expected
weight * `SHARE` times: the whole part of that is given as copies, the rest drawn. So the expected tokens of every source,
language and topic are in the target proportions, and all together are SHARE of the table's, whatever its rarest cell.

Nulls are a value of their own in each dimension. A value without a target keeps no share; a target without tokens is left
out and the others share its part. Documents without tokens follow their cell, and a cell without any tokens is kept as it
is, once. The draw depends on id and seed alone, so repeated rows share one fate, as do repeated runs. An empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmeter.llm.common import cut_lineage, settle, words_of

NONE = "\x00"
#: Targets are shares raised to this power: small sources get more than their share, large ones less.
ALPHA = 0.7
#: Expected tokens of the sample, as a share of those of the table.
SHARE = 1.0
TOLERANCE, ROUNDS = 1e-6, 50
#: Cell tables up to this size (24 MB) are raked by numpy on the driver, larger ones by joins; the results are the same.
LOCAL_CELLS = 1_000_000


def topic_of(text: Column) -> Column:
    """Kind of a text by its form, as the table names no topics: table, symbols, brief, long or prose."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)

    def of(c: str) -> Column:
        return size - F.length(F.replace(text, F.lit(c), F.lit("")))

    return (
        F.when(of("|") * 50 > size, "table").when((of("#") + of("$") + of("%") + of("*")) * 50 > size, "symbols")
        .when(size < 500, "brief").when(size > 8000, "long").otherwise("prose")
    )


def smoothed(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """(dim, share): target shares from those of the tokens, evened out by a power below 1."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("share"))
    return sums.filter("share > 0")


def rake_arrays(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], tolerance: float, rounds: int) -> np.ndarray:
    """Weights of cells; codes are the cell's value in each dimension, goals the target sum of each value."""
    weight = np.ones(len(tokens))
    for _ in range(rounds):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            sums = np.bincount(code, weights=tokens * weight, minlength=len(goal))
            worst = max(worst, float(np.abs(goal - sums).max()))
            weight = weight * np.where(sums > 0, goal / np.where(sums > 0, sums, 1), 1.0)[code]
        if worst <= tolerance * tokens.sum():
            break
    return weight


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS, local: int = LOCAL_CELLS,
) -> DataFrame:
    """Adds `weight` to cells (dimensions and `tokens`) so that sums of tokens * weight have the target shares.

    The size of the cell table is that of the combinations, not of the documents. Where cells are missing, the targets may
    contradict each other; the weights are then those of the last round.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("weight", F.lit(1.0))
    if not total:
        return cells
    goals = {}
    for dim, target in targets.items():
        present = target.join(cells.filter("tokens > 0").select(dim).distinct(), dim)
        whole = present.agg(F.sum("share")).first()[0]
        goals[dim] = cut_lineage(present.select(dim, (F.col("share") * F.lit(total / whole)).alias("goal")))
    if cells.count() <= local:
        names = list(goals)
        table = cells.drop("weight").toPandas()
        codes, sums = [], []
        for dim in names:
            goal = {r[0]: r[1] for r in goals[dim].collect()}
            values = sorted(set(table[dim]))
            place = {v: i for i, v in enumerate(values)}
            codes.append(table[dim].map(place).to_numpy())
            sums.append(np.array([goal.get(v, 0.0) for v in values]))
        table["weight"] = rake_arrays(table["tokens"].to_numpy(dtype=np.float64), codes, sums, tolerance, rounds)
        return cells.sparkSession.createDataFrame(table, cells.schema)
    for _ in range(rounds):
        off = []
        for dim, goal in goals.items():
            sums = cells.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("weight")).alias("sum")).join(goal, dim, "left")
            factor = F.when(F.col("sum") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("sum")).otherwise(F.lit(1.0))
            sums = sums.select(dim, factor.alias("_factor"), F.abs(F.coalesce("goal", F.lit(0.0)) - F.col("sum")).alias(f"_off_{dim}"))
            cells = cells.join(sums, dim).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_factor")
            off.append(f"_off_{dim}")
        cells = cut_lineage(cells)
        worst = cells.agg(F.max(F.greatest(*off)) if len(off) > 1 else F.max(off[0])).first()[0]
        cells = cells.drop(*off)
        if worst <= tolerance * total:
            break
    return cells


def sample(
    docs: DataFrame, dims: dict[str, Column], tokens: Column, doc_id: str = "doc_id", targets: dict[str, DataFrame] | None = None, seed: int = 13,
    share: float = SHARE,
) -> DataFrame:
    """Rows of `docs` as a struct `row`, with tokens, the dimensions, weight, probability of being kept, whether the draw keeps them and how often."""
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("_id"), tokens.cast("long").alias("tokens"),
        *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(d) for d, c in dims.items()],
    )
    cells = settle(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    weights = rake(cells, targets or {d: smoothed(cells, d) for d in dims})
    times = F.when(F.col("cell_tokens") > 0, F.col("weight") * F.lit(share)).otherwise(F.lit(1.0))
    weights = weights.withColumnRenamed("tokens", "cell_tokens").withColumn("_times", times).drop("cell_tokens")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_id")), 11).cast("double") / float(1 << 53)
    whole = F.floor("_times")
    copies = (whole + F.when(draw < F.col("_times") - whole, 1).otherwise(0)).cast("int")
    found = rows.join(weights, list(dims)).withColumns({"probability": F.least(F.col("_times"), F.lit(1.0)), "copies": copies})
    return found.select("row", "tokens", *dims, "weight", "probability", (F.col("copies") > 0).alias("kept"), "copies")


def document_dims() -> dict[str, Column]:
    return {"by_source": F.col("source"), "by_lang": F.col("lang"), "by_topic": topic_of(F.col("text"))}


def document_tokens() -> Column:
    return F.size(words_of(F.col("text")))
