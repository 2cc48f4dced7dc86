from __future__ import annotations

import pytest

from gridmeter.sources import read_user_csv
from gridmeter.sources import user_files


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows(df):
    return sorted((r.upload_id, r.timestamp, r.energy_consumption) for r in df.na.fill("-").collect())


def test_every_file_by_its_own_header(spark, tmp_path):
    put(tmp_path, "a.csv", "energy_consumption,timestamp\n1.5,2024-01-01 00:00\nNA,2024-01-01 01:00\n")
    put(tmp_path, "deep/b.csv", '\ufefftimestamp,note,energy_consumption\r\n2024-01-01,"two\r\nlines, and ""quotes""",2\r\n\r\n2024-01-02,x\r\n')
    put(tmp_path, "c.csv", "timestamp\n2024-03-01\n")
    put(tmp_path, "twice.csv", ",timestamp,timestamp,energy_consumption\n0,first,second,3\n")
    put(tmp_path, "header_only.csv", "timestamp,energy_consumption\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "_SUCCESS", "timestamp\nhidden\n")
    assert rows(read_user_csv(spark, str(tmp_path))) == [
        ("a", "2024-01-01 00:00", "1.5"), ("a", "2024-01-01 01:00", "-"), ("b", "2024-01-01", "2"), ("b", "2024-01-02", "-"),
        ("c", "2024-03-01", "-"), ("twice", "first", "3"),
    ]
    headers = {r.upload_id: r.header for r in read_user_csv(spark, [str(tmp_path / "deep"), str(tmp_path / "t*.csv")]).collect()}
    assert headers == {"b": ["timestamp", "note", "energy_consumption"], "twice": ["timestamp", "timestamp", "energy_consumption"]}


def test_one_scan_and_no_join(spark, tmp_path):
    put(tmp_path, "a.csv", "timestamp,energy_consumption\n2024-01-01,1\n")
    plan = read_user_csv(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan and "Exchange" not in plan


def test_files_are_packed_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(user_files, "PACK_BYTES", 30)
    for i, size in enumerate([10, 10, 10, 50, 10, 25]):
        put(tmp_path, f"{i}.csv", "x" * size)
    packs = user_files.UserFileReader([str(tmp_path)]).partitions()
    assert [[p.rsplit("/", 1)[1][0] for p in pack.paths] for pack in packs] == [["0", "1", "2"], ["3"], ["4"], ["5"]]


def test_an_empty_file_comes_first_and_folders_stay_apart(tmp_path):
    put(tmp_path, "one/0.csv", "")
    put(tmp_path, "two/0.csv", "")
    packs = user_files.UserFileReader([str(tmp_path / "one"), str(tmp_path / "two")]).partitions()
    assert [(p.source, len(p.paths)) for p in packs] == [(str(tmp_path / d), 1) for d in ("one", "two")]


def test_long_files_and_bytes_that_are_no_text(spark, tmp_path):
    n = 3 * user_files.BATCH_ROWS + 5
    put(tmp_path, "long.csv", "timestamp,energy_consumption\n" + "".join(f"t{i},{i}\n" for i in range(n)))
    put(tmp_path, "odd.csv", b"timestamp,energy_consumption\n\xff\x00,1\n")
    got = read_user_csv(spark, str(tmp_path))
    assert got.filter("upload_id = 'long'").selectExpr("count(*)", "sum(cast(energy_consumption AS bigint))").first()[:] == (n, n * (n - 1) // 2)
    assert got.filter("upload_id = 'odd'").first().timestamp == "\ufffd\x00"


def test_nothing_there(spark, tmp_path):
    assert read_user_csv(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        read_user_csv(spark, str(tmp_path / "missing")).count()
