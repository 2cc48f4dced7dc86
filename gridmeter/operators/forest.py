"""Random forest without a depth limit: every tree is grown to its end in a task of its own, all trees side by side.

A tree takes each row as often as a Poisson draw with mean 1 says, which a hash of row and tree decides, so nothing depends on how
rows are dealt out. Nodes of more than `NODE_SIZE` rows are split, where splitting lowers the squared error, by the best of a third
of the columns, drawn for each node. Values are binned by quantiles as in `boosting`, and sums are whole numbers.

A full forest has as many leaves as the rows allow, so the fit takes at most about `SAMPLE` rows, drawn by hash; that bounds a tree's
task and the model that is broadcast for predictions. Rows with a null or NaN feature or label are left out of the fit, and their
predictions are null.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmeter.operators.boosting import (
    BINS, UNIT, BoostConfig, BoostedTrees, Tree, _settle, best_splits, blocks_of, quantile_edges, unpacked,
)

TREES, NODE_SIZE = 50, 5
SAMPLE = 100_000
#: Nodes whose sums are held at once.
NODES = 128
_RULE = BoostConfig(1.0, 0, 1, 1.0, 1.0, 0.0, 0.0, 0.0)


def poisson(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree takes each row: Poisson with mean 1, by a hash."""
    x = ids.view(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    reached = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(reached, share, side="right").astype(np.int64)


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, tree: int, seed: int = 42, node_size: int = NODE_SIZE) -> Tree:
    """One tree over rows at hand; its values are mean labels."""
    use = np.flatnonzero(weight)
    bins, weight = bins[use], weight[use]
    total = np.rint(label[use] * UNIT).astype(np.int64) * weight
    grown, columns = Tree(), bins.shape[1]
    leaf, active = np.zeros(len(use), dtype=np.int64), [0]
    third = max(1, columns // 3)
    while active and len(leaf):
        after = []
        for lo in range(0, len(active), NODES):
            nodes = active[lo : lo + NODES]
            place = np.full(len(grown.column), -1, dtype=np.int64)
            place[nodes] = np.arange(len(nodes))
            at = place[leaf] if len(place) > leaf.max() else np.full(len(leaf), -1)
            mine = np.flatnonzero(at >= 0)
            code = ((at[mine, None] * columns + np.arange(columns)) * BINS + bins[mine]).ravel()
            size = len(nodes) * columns * BINS
            sums = np.stack([np.bincount(code, np.repeat(x[mine], columns), size) for x in (total, weight)]).reshape(2, len(nodes), columns, BINS)
            whole = sums[:, :, 0, :].sum(axis=2)
            allowed = np.zeros((len(nodes), columns), dtype=bool)
            for i, node in enumerate(nodes):
                grown.value[node] = float(whole[0, i] / UNIT / whole[1, i])
                allowed[i, np.random.default_rng([seed, tree, node]).permutation(columns)[:third]] = True
            # Columns that are not drawn hold all rows in one bin, and so allow no cut.
            sums[:, ~allowed] = 0
            for i, (gain, column, cut) in enumerate(best_splits(sums, _RULE)):
                if whole[1, i] > node_size and gain > 1e-9:
                    grown.split(nodes[i], column, cut, gain)
                    after += [grown.left[nodes[i]], grown.right[nodes[i]]]
        column, cut, left, right = (np.array(x, dtype=np.int64) for x in (grown.column, grown.bin, grown.left, grown.right))
        on = np.flatnonzero(column[leaf] >= 0)  # rows at final leaves are done
        bins, weight, total, leaf = bins[on], weight[on], total[on], leaf[on]
        leaf = np.where(bins[np.arange(len(on)), column[leaf]] <= cut[leaf], left[leaf], right[leaf])
        active = after
    return grown


def train_forest(
    train: DataFrame, cols: Sequence[str], target: str = "energy_kwh", trees: int = TREES, seed: int = 42, keys: Sequence[str] = ("series_id", "ts"),
    sample: int = SAMPLE, node_size: int = NODE_SIZE,
) -> BoostedTrees:
    """A forest as a sum of trees whose values are shares of the mean."""
    rows = train.count()
    if rows > sample:
        train = train.filter(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < F.lit(int(sample / rows * (1 << 30))))
    edges = quantile_edges(train, cols)
    blocks = _settle(blocks_of(train, cols, F.col(target), F.lit(False), edges, keys), "forest-blocks")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(*r) for r in group.sort_values("block")[["ids", "bins", "label", "held_out"]].itertuples(index=False)]
        ids, bins, label, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
        number = int(group["tree"].iloc[0])
        return pd.DataFrame({"tree": [number], "grown": [json.dumps(asdict(grow(bins, label, poisson(ids, number, seed), number, seed, node_size)))]})

    each = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    found = each.groupBy("tree").applyInPandas(run, "tree int, grown string").collect()  # one row a tree, of at most twice the sample's nodes
    if not found:
        raise ValueError("no training row has all features and a label")
    grown = [Tree(**json.loads(r["grown"])) for r in sorted(found, key=lambda r: r["tree"])]
    for tree in grown:
        tree.value = [v / len(grown) for v in tree.value]
    return BoostedTrees(list(cols), edges, 0.0, False, grown)


def depth(tree: Tree) -> int:
    """Splits on the longest way from the root to a leaf."""
    deep, most = [(0, 0)], 0
    while deep:
        node, level = deep.pop()
        most = max(most, level)
        if tree.column[node] >= 0:
            deep += [(tree.left[node], level + 1), (tree.right[node], level + 1)]
    return most
