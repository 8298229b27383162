"""Windows and pages by jumps against loops over all rows, with one key that fills many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators.jumps import anchored_windows, pages, successors


def windows_by_loop(rows, seconds, limit):
    want, state = [], {}
    for k, t, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        end, n = state.get(k, (None, 0))
        if t is not None and (end is None or t >= end):
            end, n = t + seconds * 1_000_000, 0
        state[k] = end, n + 1
        want.append((k, i, n < limit))
    return want


def pages_by_loop(rows, files, most):
    want, state = [], {}
    for k, z, i in sorted(rows, key=lambda r: r[2]):
        page, held, size = state.get(k, (-1, files, 0))
        z = max(z or 0, 0)
        if held >= files or size + z > most:
            page, held, size = page + 1, 0, 0
        state[k] = page, held + 1, size + z
        want.append((k, i, page))
    return want


def by_repr(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 16), (2, 40)])
def test_anchored_windows(spark, seed, block):
    rnd = random.Random(seed)
    n = 300
    rows = [(rnd.choice(["hot"] * 9 + ["a", None]), rnd.choice([None] + [rnd.randrange(n * 300_000)] * 15), i) for i in range(n)]
    got = anchored_windows(spark.createDataFrame(rows, "k string, t long, i long"), ["k"], "t", "i", 2, 3, block).collect()
    assert by_repr(got) == by_repr(windows_by_loop(rows, 2, 3))


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 16), (2, 40)])
def test_pages(spark, seed, block):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 9 + ["a", None]), rnd.choice([None, 0, 0, rnd.randrange(40), 500, -3]), i) for i in range(300)]
    got = pages(spark.createDataFrame(rows, "k string, z long, i long"), ["k"], "i", "z", 4, 90, block).collect()
    assert by_repr(got) == by_repr(pages_by_loop(rows, 4, 90))


def test_two_keys(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), rnd.choice([1, 2, None]), rnd.randrange(10**8), i) for i in range(200)]
    df = spark.createDataFrame(rows, "x string, y long, t long, i long")
    got = anchored_windows(df, ["x", "y"], "t", "i", 3, 2, 16).collect()
    want = windows_by_loop([((x, y), t, i) for x, y, t, i in rows], 3, 2)
    assert by_repr(got) == by_repr((*k, i, ok) for k, i, ok in want)


def test_successors(spark):
    df = spark.createDataFrame([(1, v, i + 1) for i, v in enumerate([0, 0, 5, 7, 7, 20])], "k long, v long, n long")
    got = successors(df, ["k"], "n", F.col("v"), F.col("v") + 7, []).orderBy("n").collect()
    assert [r._next for r in got] == [4, 4, 6, 6, 6, 7]


def test_ties_and_nothing(spark):
    """Hits of one moment share a window; a table without rows gives none."""
    df = spark.createDataFrame([("k", 5, i) for i in range(6)], "k string, t long, i long")
    assert sorted((r.i, r.allowed) for r in anchored_windows(df, ["k"], "t", "i", 1, 2, 2).collect()) == [(i, i < 2) for i in range(6)]
    assert anchored_windows(df.limit(0), ["k"], "t", "i", 1, 2).collect() == [] and pages(df.limit(0), ["k"], "i", "t", 2, 2).collect() == []
