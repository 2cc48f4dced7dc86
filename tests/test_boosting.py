"""Boosted trees against a plain version that looks at every row, split across tasks and in one, kept and read again."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridmeter.operators import boosting as b

COLS = ["x", "y", "z"]


def rows_of(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    label = np.where(x[:, 0] > 0.2, 2.0, 0.5) + 0.7 * (x[:, 1] ** 2) + rng.normal(0, 0.1, n) + 1
    return [(i, *map(float, v), float(t), bool(i % 4 == 0)) for i, (v, t) in enumerate(zip(x, label, strict=True))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "series_id long, x double, y double, z double, energy_kwh double, valid boolean")


def plain(bins, label, held_out, ids, base, config, rounds, seed=42):
    """Trees as nested tuples, each split found by trying every column and cut over the rows of the node."""
    margin, out = [base] * len(label), []

    def score(g, n):
        return (math.copysign(max(abs(g) - config.alpha, 0), g)) ** 2 / (n + config.penalty)

    for number in range(rounds):
        cols = b.columns_of(number, bins.shape[1], config.column_share, seed)
        use = b.drawn(ids, number, config.subsample) & ~held_out
        grad = [round((m - t) * b.UNIT) / b.UNIT for m, t in zip(margin, label, strict=True)]

        def grow(rows, depth):
            g, best = sum(grad[i] for i in rows), (max(config.min_gain, 1e-9), None, None)
            if depth < config.depth:
                for c in cols:
                    for cut in range(b.BINS):
                        left = [i for i in rows if bins[i, c] <= cut]
                        right = len(rows) - len(left)
                        if min(len(left), right) >= max(config.min_rows, 1):
                            gl = sum(grad[i] for i in left)
                            gain = score(gl, len(left)) + score(g - gl, right) - score(g, len(rows))
                            if gain > best[0] * (1 + 1e-12):
                                best = (gain, int(c), cut)
            if best[1] is None:
                return -config.eta * math.copysign(max(abs(g) - config.alpha, 0), g) / (len(rows) + config.penalty)
            _, c, cut = best
            return (c, cut, grow([i for i in rows if bins[i, c] <= cut], depth + 1), grow([i for i in rows if bins[i, c] > cut], depth + 1))

        tree = grow(np.flatnonzero(use).tolist(), 0)
        out.append(tree)
        for i in range(len(label)):
            node = tree
            while isinstance(node, tuple):
                node = node[2] if bins[i, node[0]] <= node[1] else node[3]
            margin[i] += node
    return out


def nested(tree, node=0):
    if tree.column[node] < 0:
        return tree.value[node]
    return tree.column[node], tree.bin[node], nested(tree, tree.left[node]), nested(tree, tree.right[node])


def assert_same(one, other):
    assert isinstance(one, tuple) == isinstance(other, tuple)
    if isinstance(one, tuple):
        assert one[:2] == other[:2]
        assert_same(one[2], other[2])
        assert_same(one[3], other[3])
    else:
        assert one == pytest.approx(other, rel=1e-9)


@pytest.mark.parametrize("config", [b.BoostConfig(0.3, 3, 3, 0.8, 0.7, 0.0, 0.1, 1.0), b.BoostConfig(0.5, 2, 8, 1.0, 1.0, 0.5, 0.0, 2.0)])
def test_trees_equal_a_plain_version(config):
    rows = rows_of(500)
    x, label = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    edges = [np.quantile(x[:, i], np.arange(1, 12) / 12).tolist() for i in range(3)]
    bins, held_out, ids = b.binned(x, edges), np.array([r[5] for r in rows]), np.arange(500)
    trees, errors = b.grow(ids, bins, label, held_out, 1.0, config, 4, 50, 42)
    want = plain(bins, label, held_out, ids, 1.0, config, 4)
    assert len(trees) == len(errors) == 4
    for tree, w in zip(trees, want, strict=True):
        assert_same(nested(tree), w)


def test_one_task_and_many_give_the_same_trees(spark):
    df = frame(spark, rows_of(900)).repartition(5)
    grid = [b.BoostConfig(0.3, 3, 3, 0.8, 0.7, 0.0, 0.1, 1.0)]
    parts = df.filter("NOT valid").drop("valid"), df.filter("valid").drop("valid")
    both = [b.tune(*parts, COLS, grid, "energy_kwh", keys=["series_id"], rounds=3, group=group) for group in (10**6, 10)]
    assert both[0][0].to_json() == both[1][0].to_json() and both[0][1] == both[1][1]


def test_patience_keeps_the_best_round_and_errors_fall(spark):
    df = frame(spark, rows_of(900))
    grid = [b.BoostConfig(0.3, 3, 3, 0.8, 0.7, 0.0, 0.1, 1.0), b.BoostConfig(0.0001, 1, 3, 0.8, 0.7, 0.0)]
    model, told = b.tune(df.filter("NOT valid"), df.filter("valid"), COLS, grid, "energy_kwh", keys=["series_id"], rounds=400, patience=10)
    assert told[0]["rounds_run"] == told[0]["rounds_kept"] + 10 < 400 and told[0]["validation_mae"] < 0.2 < told[1]["validation_mae"]
    assert len(model.trees) == told[0]["rounds_kept"]
    ranked = model.importance(spark).collect()
    assert [r.rank for r in ranked] == [1, 2, 3] and ranked[-1].feature == "z" and sum(r.gain for r in ranked) == pytest.approx(1)


def test_rows_without_a_feature_have_no_prediction(spark):
    rows = rows_of(300)
    holes = [(1000, None, 1.0, 1.0, 1.0, False), (1001, float("nan"), 1.0, 1.0, 1.0, True), (1002, 1.0, 1.0, 1.0, None, False)]
    df = frame(spark, rows + holes)
    model, _ = b.tune(df.filter("NOT valid"), df.filter("valid"), COLS, [b.BoostConfig(0.3, 2, 3, 1.0, 1.0, 0.0)], "energy_kwh", keys=["series_id"], rounds=5)
    found = {r.series_id: r.prediction for r in b.with_prediction(df, model).collect()}
    assert found[1000] is None and found[1001] is None and found[1002] is not None and all(found[i] >= 0 for i in range(300))
    with pytest.raises(ValueError, match="no training row"):
        b.tune(df.limit(0), df.limit(0), COLS, [b.BoostConfig(0.3, 2, 3, 1.0, 1.0, 0.0)], "energy_kwh", keys=["series_id"])


def test_a_kept_model_is_fitted_once(spark, tmp_path):
    df, calls = frame(spark, rows_of(300)), []

    def fit():
        calls.append(1)
        model, told = b.tune(df.filter("NOT valid"), df.filter("valid"), COLS, [b.BoostConfig(0.3, 2, 3, 1.0, 1.0, 0.0)], "energy_kwh", keys=["series_id"], rounds=5)
        return model, {"settings": told, "p90": 1.5}

    key = b.table_hash(df)
    first, second = (b.kept_model(spark, str(tmp_path), key, fit) for _ in range(2))
    assert calls == [1] and first[0].to_json() == second[0].to_json() and second[1]["features"] == COLS and second[1]["p90"] == 1.5
    assert b.table_hash(df.repartition(7)) == key != b.table_hash(df.union(df.limit(1)))
