"""Snapshot rules on a few batches."""

from lumenfold.operators import snapshot

KINDS = "tenant long, batch_id long, status string, expected long, total long, completed long, succeeded long, failed long, skipped long, active long, faces long, avg_ms double, rate double"


def row(tenant, batch, status, expected, total, completed, avg_ms=None, rate=0.0):
    return (tenant, batch, status, expected, total, completed, completed, 0, 0, 0, 0, avg_ms, rate)


def test_batches(spark):
    rows = [row(1, 1, "receiving", 10, 4, 1, 500.0), row(1, 2, "receiving", 2, 4, 1, None, 0.7), row(1, 3, "running", 99, 4, 4), row(1, 4, "finalizing", None, 4, 4), row(1, 5, "completed", None, 4, 4), row(1, 6, "running", None, 0, 0), row(1, 7, "receiving", None, 3, 0)]
    got = {r.batch_id: (r.shown, r.remaining, r.progress, r.eta_s) for r in snapshot.batches(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == {1: (10, 9, 10.0, 5), 2: (4, 3, 25.0, 5), 3: (4, 0, 100.0, 0), 4: (4, 0, 100.0, None), 6: (0, 0, 0.0, 0), 7: (3, 3, 0.0, None)}


def test_summary_eta(spark):
    rows = [row(1, 1, "running", None, 4, 4), row(1, 2, "finalizing", None, 4, 4), row(2, 3, "running", None, 4, 4), row(3, 4, "running", None, 9, 2), row(4, 5, "running", None, 9, 2, 1000.0), row(4, 6, "running", None, 5, 5), row(5, 7, "running", None, 9, 2, 1000.0), row(5, 8, "running", None, 5, 1), row(6, 9, "completed", None, 5, 1)]
    rates = spark.createDataFrame([(3, 2.0, 1.0), (1, 2.0, 1.0)], "tenant long, images_per_s double, faces_per_s double")
    found = {r.tenant: r for r in snapshot.summary(snapshot.batches(spark.createDataFrame(rows, KINDS)), "tenant", rates).collect()}
    assert {k: r.eta_s for k, r in found.items()} == {1: None, 2: 0, 3: 4, 4: 7, 5: None}
    assert (found[4].running_batches, found[4].total, found[4].completed, found[4].remaining, found[4].images_per_s) == (2, 14, 7, 7, 0.0)
