"""Scans across ranges against a loop over all rows, with one key that holds nearly all of them."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators.scans import CHUNK, paced, running, spread, trailing


@pytest.fixture
def uncoalesced(spark):
    """Every range stays a task of its own, as it does where there is much data."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * 9 + ["a", None]), rnd.randrange(300), i, rnd.choice([None, rnd.randrange(-50, 50)])) for i in range(n)]


def test_running(uncoalesced):
    rows = rows_of(1)
    df = uncoalesced.createDataFrame(rows, "k string, t long, i long, v long")
    dealt = spread(df, ["k"], ["t", "i"])
    assert dealt.where("k = 'hot'").select(CHUNK).distinct().count() >= 3
    v = F.col("v")
    got = {r.i: (r.total, r.top, r.last, r.before) for r in running(dealt, ["k"], ["t", "i"], total=("sum", v), top=("max", v), last=("last", v), before=("before", v)).collect()}
    want, state = {}, {}
    for k, _, i, x in sorted(rows, key=lambda r: (r[1], r[2])):
        total, top, last = state.get(k, (0, None, None))
        now = (total + (x or 0), top if x is None else x if top is None else max(top, x), last if x is None else x)
        want[i], state[k] = (*now, last), now
    assert got == want


@pytest.mark.parametrize("key", [["k"], []])
def test_paced(uncoalesced, key):
    rows = [(k, t if v is not None else None, i) for k, t, i, v in rows_of(2)]
    got = {r.i: r.slot for r in paced(uncoalesced.createDataFrame(rows, "k string, t long, i long"), key, "t", "i", 7).collect()}
    want, free = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2])):
        k = k if key else 0
        want[i] = None if t is None else max(t, free.get(k, t))
        if t is not None:
            free[k] = want[i] + 7
    assert got == want


def test_trailing(uncoalesced):
    rnd = random.Random(4)
    rows = [(rnd.choice([1] * 9 + [2]), t, rnd.randrange(5), rnd.random()) for t in rnd.sample(range(1000), 300)]
    got = {(r.k, r.t): (r.first, r.n, r.x) for r in trailing(uncoalesced.createDataFrame(rows, "k long, t long, n long, x double"), "k", "t", 40, "n", "x").collect()}
    assert len(got) == len(rows)
    for k, t, _, _ in rows:
        inside = [r for r in rows if r[0] == k and t - 40 < r[1] <= t]
        first, n, x = got[k, t]
        assert (first, n) == (min(r[1] for r in inside), sum(r[2] for r in inside)) and x == pytest.approx(sum(r[3] for r in inside), abs=1e-9)


def test_empty(spark):
    empty = spark.createDataFrame([], "k long, t long, i long, n long")
    assert paced(empty, ["k"], "t", "i", 5).collect() == [] and paced(empty, [], "t", "i", 5).collect() == []
    assert trailing(empty.select("k", "t", "n"), "k", "t", 5, "n").collect() == []
