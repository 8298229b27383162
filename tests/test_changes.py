"""Changes of a stored table: what they touch, what they leave, and that a second run changes nothing."""

import hashlib
from pathlib import Path

from lumenfold.sources import changes
from lumenfold.sources.storage import fresh_path

KINDS = "id long, parent long, status string, version long"


def made(spark, n=200):
    path = fresh_path(spark, "table")
    changes.create(spark.createDataFrame([(i, i // 10 if i else None, "queued", 0) for i in range(n)], KINDS), path, "id", 8)
    return path


def files(path):
    return {str(p): hashlib.sha1(p.read_bytes()).hexdigest() for p in Path(path.removeprefix("file://")).rglob("*.parquet")}


def held(spark, path):
    return {r.id: (r.parent, r.status, r.version) for r in changes.read(spark, path).collect()}


def keys(df):
    return sorted(r.id for r in df.collect())


def test_compare_and_set(spark):
    path = made(spark)
    before, files_before = held(spark, path), files(path)
    wanted = spark.createDataFrame([(3, 0, "processing"), (3, 0, "waiting"), (4, 1, "processing"), (900, 0, "processing")], "id long, version long, status string")
    assert keys(changes.compare_and_set(spark, path, "id", "version", wanted, 8)) == [3]
    after = held(spark, path)
    assert after == before | {3: (0, "processing", 1)}
    same = {p for p, h in files(path).items() if files_before.get(p) == h}
    assert {p.split("_bucket=")[1].split("/")[0] for p in files_before} - {p.split("_bucket=")[1].split("/")[0] for p in same} == {b for b in {p.split("_bucket=")[1].split("/")[0] for p in set(files(path)) - same}}
    assert len(same) == 7
    files_after = files(path)
    assert keys(changes.compare_and_set(spark, path, "id", "version", wanted, 8)) == [] and files(path) == files_after and held(spark, path) == after


def test_insert_once(spark):
    path = made(spark, 5)
    rows = spark.createDataFrame([(4, None, "new", 0), (7, 1, "b", 0), (7, 1, "a", 0)], KINDS)
    assert keys(changes.insert(spark, path, "id", rows, 8)) == [7]
    now, stored = held(spark, path), files(path)
    assert now[7] == (1, "a", 0) and now[4][1] == "queued" and len(now) == 6
    assert keys(changes.insert(spark, path, "id", rows, 8)) == [] and files(path) == stored


def test_delete_with_cascade(spark):
    path = made(spark)
    gone = {1, *range(10, 20), *range(100, 200)}
    chosen = spark.createDataFrame([(1,), (15,), (999,)], "id long")
    before = held(spark, path)
    assert set(keys(changes.delete_cascade(spark, path, "id", "parent", chosen, 8))) == gone
    assert held(spark, path) == {i: v for i, v in before.items() if i not in gone}
    stored = files(path)
    assert keys(changes.delete_cascade(spark, path, "id", "parent", chosen, 8)) == [] and files(path) == stored
    assert keys(changes.insert(spark, path, "id", spark.createDataFrame([(1, None, "again", 0)], KINDS), 8)) == []
    erased = spark.read.parquet(path).where("_deleted").collect()
    assert len(erased) == len(gone) and all(r.status is None for r in erased)


def test_cycles_and_no_keys(spark):
    path = fresh_path(spark, "table")
    changes.create(spark.createDataFrame([(1, 2, "a", 0), (2, 1, "a", 0), (3, None, "a", 0)], KINDS), path, "id", 4)
    assert keys(changes.delete_cascade(spark, path, "id", "parent", spark.createDataFrame([], "id long"), 4)) == []
    assert keys(changes.delete_cascade(spark, path, "id", "parent", spark.createDataFrame([(2,)], "id long"), 4)) == [1, 2]
