"""The ring of stamped slots: rules, and disordered input in several micro-batches."""

import random

import pytest

from lumenfold.sources.storage import fresh_path
from lumenfold.streaming import rates
from lumenfold.streaming.rates import SLOTS, Ring

KINDS = "scope long, second long, images long, faces long"


def filled(*counts):
    ring = Ring()
    return ring, [ring.add(*c) for c in counts]


def test_slots_are_stamped():
    ring, taken = filled((5, 1, 2), (5 + SLOTS, 3, 4), (5, 9, 9), (5 + SLOTS, 1, 1))
    assert taken == [True, True, False, True]
    assert ring.read(5 + SLOTS)[:2] == (4, 5) and ring.read(5) == (0, 0, 0.0, 0.0)


def test_window_and_its_length():
    ring, _ = filled((70, 99, 99), (71, 1, 2), (99, 2, 6), (100, 1, 3), (101, 50, 50))
    assert ring.read(100) == (4, 11, round(4 / 30, 3), round(11 / 30, 3))
    assert filled((99, 2, 6), (100, 1, 3))[0].read(100)[2:] == (1.5, 4.5)
    assert Ring().read(100) == (0, 0, 0.0, 0.0)


def test_halves_are_rounded_as_in_sql():
    """Over 16 seconds 1 / 16 = 0.0625 lies between two results."""
    assert filled((85, 1, 3), (100, 0, 0))[0].read(100)[2:] == (0.063, 0.188)
    assert filled((85, 1, -1), (100, 0, 0))[0].read(100)[2:] == (0.063, -0.063)


def counts(spark, folder):
    return spark.readStream.schema(KINDS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


def test_disorder_late_input_and_restart(spark):
    """Rows shuffled over micro-batches and runs give the rates of the ordered log; nulls do not count, and state does not grow."""
    rnd = random.Random(6)
    rows = [(rnd.randrange(4), rnd.randrange(1000, 1110), 1, rnd.randrange(5)) for _ in range(600)]
    want = {}
    for scope in range(4):
        ring = Ring()
        for _, second, images, faces in sorted(r for r in rows if r[0] == scope):
            ring.add(second, images, faces)
        now = max(r[1] for r in rows if r[0] == scope)
        want[scope] = (now, *ring.read(now))
    folder, sink, marks = (fresh_path(spark, n) for n in ("counts", "sink", "marks"))
    rows += [(1, None, 5, 5), (9, None, 1, 1)]
    rnd.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], KINDS).coalesce(1).write.parquet(f"{folder}/{k}")
        if k:
            rates.run(counts(spark, folder), sink, marks)
    got = {r.scope: tuple(r)[1:] for r in rates.latest(spark.read.schema(rates.OUT).parquet(sink)).collect()}
    assert got == {k: (v[0], v[1], v[2], pytest.approx(v[3]), pytest.approx(v[4])) for k, v in want.items()}
