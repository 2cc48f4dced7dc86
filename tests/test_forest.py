"""Trees grown to the end against a plain recursion, the draw of rows, and predictions."""

from __future__ import annotations

import numpy as np
import pytest

from gridmeter.operators import boosting as b
from gridmeter.operators import forest as fo


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)).round(2)
    return x, np.round(3 * (x[:, 0] > 0) + x[:, 1] + rng.normal(0, 0.2, n) + 5, 2)


def plain(grown, node, rows, bins, label, weight, tree):
    """Checks every node: its mean, and that its cut is the best of its drawn columns, or that none is allowed."""
    w, y = weight[rows].astype(float), label[rows]
    assert grown.value[node] == pytest.approx((w * y).sum() / w.sum(), rel=1e-6)
    columns = np.random.default_rng([42, tree, node]).permutation(bins.shape[1])[: bins.shape[1] // 3]
    best = 0.0
    for c in columns:
        for cut in range(b.BINS):
            left = bins[rows, c] <= cut
            if left.any() and not left.all():
                score = [(w[m] * y[m]).sum() ** 2 / w[m].sum() for m in (left, ~left)]
                best = max(best, sum(score) - (w * y).sum() ** 2 / w.sum())
    if grown.column[node] < 0:
        assert w.sum() <= fo.NODE_SIZE or best <= 1e-6
        return
    assert w.sum() > fo.NODE_SIZE and grown.column[node] in columns and grown.gain[node] == pytest.approx(best, rel=1e-5, abs=1e-5)
    left = bins[rows, grown.column[node]] <= grown.bin[node]
    plain(grown, grown.left[node], rows[left], bins, label, weight, tree)
    plain(grown, grown.right[node], rows[~left], bins, label, weight, tree)


@pytest.mark.parametrize("tree", [0, 3])
def test_every_node_is_split_as_well_as_can_be(tree):
    x, label = data(400)
    bins = b.binned(x, [np.quantile(x[:, i], np.arange(1, 20) / 20).tolist() for i in range(6)])
    weight = fo.poisson(np.arange(400), tree, 42)
    grown = fo.grow(bins, label, weight, tree)
    plain(grown, 0, np.flatnonzero(weight), bins, label, weight, tree)
    assert fo.depth(grown) > 8


def test_rows_are_drawn_as_poisson():
    drawn = np.concatenate([fo.poisson(np.arange(20_000), t, 42) for t in range(5)])
    shares = np.bincount(drawn) / len(drawn)
    assert shares[:4] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.01) and drawn.mean() == pytest.approx(1, abs=0.02)


def test_forest_predicts_and_does_not_depend_on_partitions(spark):
    x, label = data(1500)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, label, strict=True))]
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame(rows + [(9000, None, *[0.0] * 5, 1.0)], "series_id long, " + ", ".join(f"{c} double" for c in cols) + ", energy_kwh double")
    train = df.filter("series_id < 1000 OR series_id = 9000")
    one, other = (fo.train_forest(d, cols, trees=12, keys=["series_id"]) for d in (train.repartition(3), train.coalesce(1)))
    assert [t.value for t in one.trees] == [t.value for t in other.trees]
    found = b.with_prediction(df.filter("series_id >= 1000"), one).collect()
    assert np.mean([abs(r.prediction - r.energy_kwh) for r in found if r.series_id < 9000]) < 0.5
    assert [r.prediction for r in found if r.series_id == 9000] == [None]
    small = fo.train_forest(train, cols, trees=2, keys=["series_id"], sample=200)
    assert sum(len(t.column) for t in small.trees) < 0.4 * sum(len(t.column) for t in one.trees[:2])
    with pytest.raises(ValueError, match="no training row"):
        fo.train_forest(train.limit(0), cols, trees=2, keys=["series_id"])
