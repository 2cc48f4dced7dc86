from __future__ import annotations

import random

import pytest

from gridmeter.sources import StoredCatalog

SCHEMA = "id string, user_id long, file_name string, size long"


@pytest.fixture
def rows(spark):
    return lambda data: spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def store(spark, rows, tmp_path):
    return StoredCatalog(spark, str(tmp_path / "catalog"), rows([]).schema, buckets=8)


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_empty_table_and_unknown_keys(store, rows):
    assert content(store.snapshot()) == [] and store.snapshot().columns == ["id", "user_id", "file_name", "size"]
    store.append(rows([]), 1)
    assert content(store.delete(rows([("a", 1, None, None)]), 2)) == [] and content(store.select({"user_id": 1})) == []


def test_append_replace_delete_and_owner(store, rows):
    store.append(rows([("a", 1, "x", 1), ("b", 1, "y", 2), ("a", 2, "z", 3), (None, None, "n", 4)]), 1)
    store.append(rows([("a", 1, "new", None)]), 2)
    assert content(store.select({"user_id": 1}, ["id", "file_name"])) == [("a", "new"), ("b", "y")]
    assert content(store.select({"file_name": "x"})) == []  # the older change of (1, a) no longer counts
    gone = store.delete(rows([("a", 1, None, None), ("a", 1, None, None), ("b", 2, None, None)]), 3)
    assert content(gone) == [("a", 1, "new", None)]  # b is not user 2's to delete
    assert content(store.snapshot()) == sorted([("b", 1, "y", 2), ("a", 2, "z", 3), (None, None, "n", 4)], key=repr)
    store.append(rows([("a", 1, "back", 9)]), 4)
    assert content(store.select({"user_id": 1, "id": "a"})) == [("a", 1, "back", 9)]
    assert content(gone) == [("a", 1, "new", None)]
    assert content(store.delete(rows([(None, None, None, None)]), 5)) == []


def test_a_batch_that_runs_twice_is_there_once(store, rows):
    data = rows([(str(n), n % 5, "f", n) for n in range(40)])
    for _ in range(2):
        store.append(data, 1)
    assert store.changes().count() == 40
    keys = rows([("3", 3, None, None), ("4", 4, None, None)])
    first, second = content(store.delete(keys, 2)), content(store.delete(keys, 2))
    assert first == second == [("3", 3, "f", 3), ("4", 4, "f", 4)] and store.changes().count() == 42


def test_equal_keys_in_one_batch_keep_one_row(store, rows):
    store.append(rows([("a", 1, "x", 1), ("a", 1, "y", 0), ("a", 1, "y", 0)]), 1)
    assert content(store.snapshot()) == [("a", 1, "y", 0)]


def test_one_user_reads_one_bucket(store, rows):
    store.append(rows([(str(n), n, "f", n) for n in range(100)]), 1)
    one = store.select({"user_id": 7})
    assert content(one) == [("7", 7, "f", 7)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(user_id,7)" in plan
    bucket = store.changes().filter("user_id = 7").first().bucket
    assert "(bucket#" in plan and f"= {bucket})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_compaction_and_random_changes_equal_a_dict(spark, store, rows, tmp_path):
    rng, model = random.Random(4), {}
    for batch in range(1, 7):
        if batch % 3:
            data = {(str(rng.randint(0, 9)), rng.randint(0, 3)): (f"v{batch}", rng.randint(0, 99)) for _ in range(12)}
            store.append(rows([(*k, *v) for k, v in data.items()]), batch)
            model.update(data)
        else:
            keys = {(str(rng.randint(0, 9)), rng.randint(0, 3)) for _ in range(10)}
            gone = store.delete(rows([(*k, None, None) for k in keys]), batch)
            assert content(gone) == sorted(((*k, *model.pop(k)) for k in keys & set(model)), key=repr)
        assert content(store.snapshot()) == sorted(((*k, *v) for k, v in model.items()), key=repr)
    small = store.compact(str(tmp_path / "compact"))
    assert content(small.snapshot()) == content(store.snapshot()) and small.changes().count() == len(model)


def test_columns_of_its_own_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        StoredCatalog(spark, str(tmp_path / "no"), spark.createDataFrame([], "id string, user_id long, batch int").schema)


def test_odd_column_names_survive(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0, "r")], "id string, user_id long, `a.b` double, row string")
    store = StoredCatalog(spark, str(tmp_path / "odd"), df.schema)
    store.append(df, 1)
    assert content(store.select({"user_id": 1})) == [("a", 1, 2.0, "r")]
