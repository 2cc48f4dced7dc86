"""Boosted regression trees by histograms: penalties on leaves, drawn rows and columns, patience on validation rows.

Values are binned by quantiles of the training rows, once. A tree grows level by level; all a level needs are the sums of
gradients and the numbers of rows by (node, column, bin). Gradients are whole numbers (2^24 to one), so the sums do not
depend on how rows are dealt out, and neither do the trees: tables of up to `GROUP` rows are grown in one task a setting, all
settings side by side, larger ones by one partial-and-final aggregate a level, and both give the same trees (tested). The driver
holds sums, trees and validation errors, never rows.

The loss is half the squared error, so a row's gradient is its prediction less its label, and its hessian 1. Of columns and bins
with equal gain the first is taken. Rows with a null or NaN feature or label are left out of fitting, and their predictions are null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmeter.session import shared_folder

ROUNDS, PATIENCE = 2000, 50
BINS = 64
#: Rows of a training table that one task may hold: 65 MB of bins for 65 columns. Larger tables are grown level by level across tasks.
GROUP = 1_000_000
BLOCK = 8192
UNIT = 1 << 24


@dataclass(frozen=True)
class BoostConfig:
    eta: float
    depth: int
    min_rows: int
    subsample: float
    column_share: float
    min_gain: float
    alpha: float = 0.0
    penalty: float = 1.0


@dataclass
class Tree:
    """Nodes by number; a leaf has column -1. Values in bins up to `bin` go left."""

    column: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, at: int, gain: float) -> None:
        self.column[node], self.bin[node], self.gain[node] = column, at, gain
        self.left[node], self.right[node] = len(self.column), len(self.column) + 1
        for values, empty in ((self.column, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            values += [empty, empty]

    def leaf_of(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The leaf, so far, of every row of bins."""
        column, at, left, right = (np.array(x, dtype=np.int64) for x in (self.column, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        for _ in range(depth):
            here = column[node]
            if (here < 0).all():
                break
            child = np.where(bins[rows, np.maximum(here, 0)] <= at[node], left[node], right[node])
            node = np.where(here < 0, node, child)
        return node


# --- what each task does with its rows -----------------------------------------------------------------------------
def gradients(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    return np.rint((margin - label) * UNIT).astype(np.int64)


def drawn(ids: np.ndarray, number: int, share: float) -> np.ndarray:
    """Rows drawn for a tree, by a hash of row and tree."""
    x = ids.view(np.uint64) + np.uint64((number + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * (1 << 53)


def histogram(bins: np.ndarray, gradient: np.ndarray, leaf: np.ndarray, nodes: Sequence[int], columns: np.ndarray) -> np.ndarray:
    """(2, nodes, columns, BINS) sums of gradients and numbers of rows; rows at other leaves are left out."""
    place = np.full(int(leaf.max(initial=0)) + max(nodes) + 1, -1, dtype=np.int64)
    place[list(nodes)] = np.arange(len(nodes))
    at = place[leaf]
    mine = np.flatnonzero(at >= 0)
    code = ((at[mine, None] * len(columns) + np.arange(len(columns))) * BINS + bins[mine][:, columns]).ravel()
    size = len(nodes) * len(columns) * BINS
    # Sums of whole doubles are exact below 2^53.
    sums = np.bincount(code, weights=np.repeat(gradient[mine].astype(np.float64), len(columns)), minlength=size).astype(np.int64)
    return np.stack([sums, np.bincount(code, minlength=size)]).reshape(2, len(nodes), len(columns), BINS)


def squared_error(label: np.ndarray, margin: np.ndarray) -> int:
    return int(np.rint((margin - label) ** 2 * UNIT).astype(np.int64).sum())


# --- what the sums decide --------------------------------------------------------------------------------------------
def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_splits(sums: np.ndarray, config: BoostConfig) -> list[tuple[float, int, int]]:
    """(gain, place of the column, bin) for every node; gain 0 where none is allowed."""
    g, n = sums[0].astype(np.float64) / UNIT, sums[1].astype(np.float64)

    def score(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        return shrunk(g, config.alpha) ** 2 / np.maximum(n + config.penalty, 1e-12)

    left_g, left_n = np.cumsum(g, axis=2), np.cumsum(n, axis=2)
    all_g, all_n = left_g[:, :, -1:], left_n[:, :, -1:]
    gain = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(all_g, all_n)
    gain[(left_n < config.min_rows) | (all_n - left_n < config.min_rows) | (left_n == 0) | (left_n == all_n)] = 0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return [(float(flat[i, b]), int(b) // BINS, int(b) % BINS) for i, b in enumerate(best)]


def columns_of(number: int, columns: int, share: float, seed: int) -> np.ndarray:
    return np.sort(np.random.default_rng([seed, number]).permutation(columns)[: max(1, math.ceil(share * columns))])


def boost(
    sums: Callable[[Tree, int, list[int], np.ndarray, int], np.ndarray], advance: Callable[[Tree, int], int], columns: int, config: BoostConfig, rounds: int,
    patience: int, seed: int,
) -> tuple[list[Tree], list[int]]:
    """Trees up to the best round, and the validation error after every round that ran.

    `sums` gives the histogram of a tree's leaves, `advance` adds a finished tree to all rows' margins and tells the error.
    """
    trees, errors = [], []
    for number in range(rounds):
        chosen, tree = columns_of(number, columns, config.column_share, seed), Tree()
        active = [0]
        for level in range(config.depth + 1):
            found = sums(tree, number, active, chosen, level)
            total = found[:, :, 0, :].sum(axis=2)
            for node, g, n in zip(active, total[0] / UNIT, total[1], strict=True):
                tree.value[node] = float(-config.eta * shrunk(np.float64(g), config.alpha) / max(n + config.penalty, 1e-12))
            if level == config.depth:
                break
            after = []
            for node, (gain, place, at) in zip(active, best_splits(found, config), strict=True):
                if gain > max(config.min_gain, 1e-9):
                    tree.split(node, int(chosen[place]), at, gain)
                    after += [tree.left[node], tree.right[node]]
            if not after:
                break
            active = after
        trees.append(tree)
        errors.append(advance(tree, config.depth))
        if number - int(np.argmin(errors)) >= patience:
            break
    return trees[: int(np.argmin(errors)) + 1], errors


def grow(ids: np.ndarray, bins: np.ndarray, label: np.ndarray, held_out: np.ndarray, base: float, config: BoostConfig, rounds: int, patience: int, seed: int):
    """Boosting over rows at hand."""
    margin = np.full(len(label), base)
    train, state = np.flatnonzero(~held_out), {}

    def sums(tree: Tree, number: int, active: list[int], chosen: np.ndarray, level: int) -> np.ndarray:
        if level == 0:
            state["rows"] = train[drawn(ids[train], number, config.subsample)]
            state["bins"], state["gradient"] = bins[state["rows"]], gradients(label[state["rows"]], margin[state["rows"]])
        return histogram(state["bins"], state["gradient"], tree.leaf_of(state["bins"], level), active, chosen)

    def advance(tree: Tree, depth: int) -> int:
        margin[:] += np.array(tree.value)[tree.leaf_of(bins, depth)]
        return squared_error(label[held_out], margin[held_out])

    return boost(sums, advance, bins.shape[1], config, rounds, patience, seed)


# --- the fitted model ------------------------------------------------------------------------------------------------
@dataclass
class BoostedTrees:
    features: list[str]
    edges: list[list[float]]
    base: float
    log_scale: bool
    trees: list[Tree]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        told = json.loads(text)
        return BoostedTrees(told["features"], told["edges"], told["base"], told["log_scale"], [Tree(**t) for t in told["trees"]])

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        bins, out = binned(x, self.edges), np.full(len(x), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaf_of(bins, len(tree.column))]
        out[np.isnan(x).any(axis=1)] = np.nan
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `prediction`, as models of Spark ML do."""
        return with_prediction(df, self)

    def importance(self, spark: SparkSession) -> DataFrame:
        """Features ranked by their share of all gain; one row a feature."""
        gains = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for column, gain in zip(tree.column, tree.gain, strict=True):
                if column >= 0:
                    gains[self.features[column]] += gain
        whole = sum(gains.values()) or 1.0
        ranked = sorted(gains.items(), key=lambda p: (-p[1], p[0]))
        return spark.createDataFrame([(i + 1, n, float(g / whole)) for i, (n, g) in enumerate(ranked)], "rank int, feature string, gain double")


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(np.array(e, dtype=np.float64), x[:, i], side="right") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def with_prediction(df: DataFrame, model: BoostedTrees, name: str = "prediction") -> DataFrame:
    """Adds the model's prediction, on the scale of the label's kWh and not below 0 if the model is of logarithms; null where a feature is."""
    shared = df.sparkSession.sparkContext.broadcast(model.to_json())  # at most rounds * 2^(depth + 1) nodes
    known: list[BoostedTrees] = []

    @F.pandas_udf("double")
    def score(features: pd.DataFrame) -> pd.Series:
        if not known:
            known.append(BoostedTrees.from_json(shared.value))
        out = known[0].predict_arrays(features.to_numpy(dtype=np.float64))
        out = np.maximum(np.expm1(out), 0) if known[0].log_scale else out
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return df.withColumn(name, score(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(model.features)])))


# --- fitting ---------------------------------------------------------------------------------------------------------
def quantile_edges(train: DataFrame, cols: Sequence[str]) -> list[list[float]]:
    """At most BINS - 1 cuts for every column, at its quantiles; a few numbers a column."""
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = train.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"e{i}") for i, c in enumerate(cols)]).first()
    return [sorted(set(e or [])) for e in found]


def blocks_of(rows: DataFrame, cols: Sequence[str], label: Column, held_out: Column, edges: list[list[float]], keys: Sequence[str]) -> DataFrame:
    """(block, n, ids, bins, label, held_out): binned rows, up to BLOCK in a row, without those that lack a value."""
    known = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(cols)]
    rows = rows.select(F.xxhash64(*keys).alias("id"), label.cast("double").alias("label"), held_out.cast("boolean").alias("held_out"), *known)
    rows = rows.replace(float("nan"), None).dropna(subset=["label", *[f"f{i}" for i in range(len(cols))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            x = np.stack([c.to_numpy() for c in batch.columns[3:]], axis=1)
            parts = [batch.column(0).to_numpy(), binned(x, edges), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first | number]), pa.array([batch.num_rows]), *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]],
                ["block", "n", "ids", "bins", "label", "held_out"])

    return rows.mapInArrow(run, "block long, n long, ids binary, bins binary, label binary, held_out binary")


def unpacked(ids: bytes, bins: bytes, label: bytes, held_out: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, np.int64), np.frombuffer(bins, np.uint8).reshape(n, -1), np.frombuffer(label), np.frombuffer(held_out, bool)


def _settle(df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def grow_in_tasks(blocks: DataFrame, base: float, grid: Sequence[BoostConfig], rounds: int, patience: int, seed: int) -> list[tuple[list[Tree], list[int]]]:
    """One task for each setting; a group is bounded by GROUP rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        parts = [unpacked(*r) for r in group[["ids", "bins", "label", "held_out"]].itertuples(index=False)]
        ids, bins, label, held_out = (np.concatenate(x) for x in zip(*parts, strict=True))
        number = int(group["config"].iloc[0])
        trees, errors = grow(ids, bins, label, held_out, base, grid[number], rounds, patience, seed)
        return pd.DataFrame({"config": [number], "trees": [json.dumps([asdict(t) for t in trees])], "errors": [errors]})

    each = blocks.withColumn("config", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])))
    found = each.groupBy("config").applyInPandas(run, "config int, trees string, errors array<long>").collect()  # one row a setting
    return [([Tree(**t) for t in json.loads(r["trees"])], list(r["errors"])) for r in sorted(found, key=lambda r: r["config"])]


def grow_across_tasks(blocks: DataFrame, base: float, config: BoostConfig, columns: int, rounds: int, patience: int, seed: int) -> tuple[list[Tree], list[int]]:
    """Sums of a level by one aggregate over all blocks. Blocks are kept where they are; only margins, 8 bytes a row, are written each round."""
    spark = blocks.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, blocks.count() // 64)
    kept = blocks.repartition(partitions, "block").persist(StorageLevel.DISK_ONLY)
    state = {"margin": None}

    def rows() -> DataFrame:
        if state["margin"] is None:
            return kept.withColumn("margin", F.lit(None).cast("binary"))
        return kept.join(state["margin"], "block")

    def margin_of(held: bytes | None, n: int) -> np.ndarray:
        return np.full(n, base) if held is None else np.frombuffer(held)

    def sums(tree: Tree, number: int, active: list[int], chosen: np.ndarray, level: int) -> np.ndarray:
        size = 2 * len(active) * len(chosen) * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, dtype=np.int64)
            for batch in batches:
                for *packed, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, bins, label, held_out = unpacked(*packed)
                    mine = np.flatnonzero(~held_out)
                    mine = mine[drawn(ids[mine], number, config.subsample)]
                    margin, bins = margin_of(held, len(ids)), bins[mine]
                    total += histogram(bins, gradients(label[mine], margin[mine]), tree.leaf_of(bins, level), active, chosen).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "x"])

        found = rows().select("ids", "bins", "label", "held_out", "margin").mapInArrow(run, "at long, x long").groupBy("at").agg(F.sum("x").alias("x"))
        out = np.zeros(size, dtype=np.int64)
        for r in found.collect():  # at most 2 * nodes * columns * BINS numbers
            out[r["at"]] = r["x"]
        return out.reshape(2, len(active), len(chosen), BINS)

    def advance(tree: Tree, depth: int) -> int:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, *packed, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, bins, label, held_out = unpacked(*packed)
                    margin = margin_of(held, len(ids)) + np.array(tree.value)[tree.leaf_of(bins, depth)]
                    error = squared_error(label[held_out], margin[held_out])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([margin.tobytes()], pa.binary()), pa.array([error])], ["block", "margin", "error"])

        told = rows().select("block", "ids", "bins", "label", "held_out", "margin").mapInArrow(run, "block long, margin binary, error long")
        told = _settle(told, "boosting-margins")
        state["margin"] = told.select("block", "margin")
        return told.agg(F.sum("error")).first()[0]

    found = boost(sums, advance, columns, config, rounds, patience, seed)
    kept.unpersist()
    return found


def tune(
    train: DataFrame, validation: DataFrame, cols: Sequence[str], grid: Sequence[BoostConfig], target: str, keys: Sequence[str] = ("series_id", "ts"),
    log_scale: bool = True, rounds: int = ROUNDS, patience: int = PATIENCE, seed: int = 42, group: int = GROUP,
) -> tuple[BoostedTrees, list[dict]]:
    """The setting with the lowest validation MAE in kWh, and what each setting came to: rounds run, rounds kept, MAE."""
    label = F.log1p(F.col(target)) if log_scale else F.col(target)
    edges = quantile_edges(train, cols)
    tagged = train.withColumn("_held_out", F.lit(False)).unionByName(validation.withColumn("_held_out", F.lit(True)))
    blocks = _settle(blocks_of(tagged, cols, label, F.col("_held_out"), edges, keys), "boosting-blocks")
    size = blocks.agg(F.sum("n")).first()[0] or 0
    # The mean label in whole units, so that it doesn't depend on the order of rows.
    mean = train.agg(F.avg(F.round(label.cast("double") * UNIT).cast("decimal(38,0)"))).first()[0]
    base = float(mean or 0) / UNIT
    if not size or mean is None:
        raise ValueError("no training row has all features and a label")
    if size <= group:
        grown = grow_in_tasks(blocks, base, grid, rounds, patience, seed)
    else:
        grown = [grow_across_tasks(blocks, base, c, len(cols), rounds, patience, seed) for c in grid]
    told, models = [], []
    for config, (trees, errors) in zip(grid, grown, strict=True):
        model = BoostedTrees(list(cols), edges, base, log_scale, trees)
        off = with_prediction(validation, model).agg(F.avg(F.abs(F.col(target) - F.col("prediction")))).first()[0]
        models.append(model)
        told.append({**asdict(config), "rounds_run": len(errors), "rounds_kept": len(trees), "validation_mae": off})
    best = min(range(len(grid)), key=lambda i: (math.inf if told[i]["validation_mae"] is None else told[i]["validation_mae"], i))
    return models[best], told


# --- models that are kept --------------------------------------------------------------------------------------------
def table_hash(df: DataFrame) -> str:
    """A hash of all rows, whatever their order; repeated rows count."""
    x = F.xxhash64(*df.columns)
    told = df.agg(F.count("*").alias("n"), F.bit_xor(x).alias("x"), F.sum(F.shiftright(x, 24)).alias("s")).first()
    return f"{told['n']}-{(told['x'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}-{(told['s'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}"


def kept_model(spark: SparkSession, base: str, key: str, fit: Callable[[], tuple[BoostedTrees, dict]]) -> tuple[BoostedTrees, dict]:
    """The model kept under `key` in the folder `base`, or a new one. The manifest is written after the model, so half a model is never read."""
    folder = f"{base.rstrip('/')}/{key}"
    try:
        manifest = json.loads(spark.read.schema("value string").text(f"{folder}/manifest").first()[0])
        return BoostedTrees.from_json(spark.read.text(f"{folder}/{manifest['model']}", wholetext=True).first()[0]), manifest
    except AnalysisException:
        model, told = fit()
        name = shared_folder(spark, "model").rsplit("/", 1)[1]
        spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(f"{folder}/{name}")
        manifest = {"model": name, "features": model.features, "log_scale": model.log_scale, **told}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        return model, manifest
