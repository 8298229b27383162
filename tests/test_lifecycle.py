"""The life cycle of batches: rules one by one, and the stream with its restarts and timers."""

from collections import Counter
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.sources.storage import fresh_path
from lumenfold.streaming import events, lifecycle
from lumenfold.streaming.lifecycle import FORGET_MS, IDLE_MS, LEASE_MS, Batch, Machine

FOLDER = "/root/testdata/sf0.001"


def played(*commands):
    """The batch after (kind, item, ms, extras) in order, and its items."""
    items, batch = {}, Batch()
    machine = Machine(batch, items.get, items.__setitem__, lambda ms, key: None, LEASE_MS, IDLE_MS)
    for n, (kind, item, ms, *extra) in enumerate(commands):
        given = {"token": None, "expected": None, "faces": None, "processor": None} | (extra[0] if extra else {})
        machine.apply(kind, item, ms, n, **given)
    return batch, items, machine


def test_seal_of_an_empty_and_a_full_batch():
    assert played(("create", 0, 0), ("seal", 0, 1))[0].status == "completed"
    assert played(("create", 0, 0), ("append", 1, 1), ("seal", 0, 2))[0].status == "running"
    done = played(("create", 0, 0), ("append", 1, 1), ("succeed", 1, 2, {"faces": 3}), ("seal", 0, 3))[0]
    assert (done.status, done.completed, done.faces, done.rejected) == ("finalizing", 1, 3, 0)
    assert played(("seal", 0, 0))[0].rejected == 1


def test_append_is_guarded():
    b = played(("append", 1, 0), ("create", 0, 1), ("append", 1, 2), ("append", 1, 3), ("create", 0, 4), ("seal", 0, 5), ("append", 2, 6))[0]
    assert (b.total, b.rejected) == (1, 4)


def test_leases_and_attempts():
    b, items, _ = played(("create", 0, 0), ("append", 1, 0), ("start", 1, 10), ("start", 1, 10 + LEASE_MS), ("start", 1, 11 + LEASE_MS), ("retry", 1, 12 + LEASE_MS), ("retry", 1, 13 + LEASE_MS), ("start", 1, 14 + LEASE_MS))
    assert (b.attempts, b.requeued, b.rejected, items[1].status, b.processing, b.queued) == (3, 1, 2, "processing", 1, 0)


def test_claims_are_compared_by_token():
    claim, wrong = {"token": 7}, {"token": 8}
    b, items, _ = played(("create", 0, 0), ("append", 1, 0), ("claim", 1, 1, claim), ("claim", 1, 2, wrong), ("confirm", 1, 3, wrong), ("confirm", 1, 4, claim), ("confirm", 1, 5, claim))
    assert (b.rejected, items[1].token) == (3, -1)
    b, items, _ = played(("create", 0, 0), ("append", 1, 0), ("claim", 1, 1, claim), ("claim", 1, 2 + LEASE_MS, wrong))
    assert (b.rejected, items[1].token) == (0, 8)


def test_terminal_counts_once_and_closes_a_declared_batch():
    b = played(("create", 0, 0, {"expected": 1}), ("append", 1, 1), ("fail", 1, 2), ("succeed", 1, 3))[0]
    assert (b.status, b.failed, b.succeeded, b.completed, b.rejected) == ("finalizing", 1, 0, 1, 1)
    b = played(("create", 0, 0, {"expected": 2}), ("append", 1, 1), ("cancel", 1, 2))[0]
    assert (b.status, b.skipped) == ("receiving", 1)


def test_outcomes_and_reopening():
    start = [("create", 0, 0), ("append", 1, 1), ("append", 2, 1), ("append", 3, 1), ("seal", 0, 2)]
    b = played(*start, ("fail", 1, 3), ("succeed", 2, 4), ("finalize", 0, 5), ("skip", 3, 6), ("finalize", 0, 7))[0]
    assert (b.status, b.rejected) == ("partial_failed", 1)
    b = played(*start, ("fail", 1, 3), ("fail", 2, 4), ("fail", 3, 5), ("finalize", 0, 6))[0]
    assert b.status == "failed"
    b = played(("create", 0, 0), ("append", 1, 1), ("seal", 0, 2), ("succeed", 1, 3), ("start", 1, 4), ("finalize", 0, 5))[0]
    assert (b.status, b.rejected) == ("completed", 1)


def test_idle_batches_are_sealed():
    assert played(("create", 0, 0), ("append", 1, IDLE_MS + 1))[0].status == "cancelled"
    b = played(("create", 0, 0), ("append", 1, IDLE_MS), ("append", 2, 2 * IDLE_MS + 1))[0]
    assert (b.status, b.auto_sealed, b.expected, b.last_ms, b.rejected) == ("running", 1, 1, 2 * IDLE_MS + 1, 1)


def test_processors_merge():
    cpu, gpu = {"processor": "cpu"}, {"processor": "gpu"}
    assert played(("create", 0, 0), ("append", 1, 1), ("start", 1, 2, cpu), ("succeed", 1, 3, {"processor": "tpu"}))[0].processor == "cpu"
    assert played(("create", 0, 0), ("append", 1, 1), ("start", 1, 2, cpu), ("succeed", 1, 3, gpu))[0].processor == "mixed"


def test_late_and_unknown_commands_are_rejected():
    b = played(("create", 0, 5), ("append", 1, 4), ("merge", 1, 6), ("", None, 7), ("advance", 1, 8))[0]
    assert (b.total, b.rejected) == (0, 4)


def put(spark, folder, number, rows):
    """A file of commands; times in ms."""
    kinds = "batch_id long, item_id long, ms long, seq long, kind string, token long, expected long, faces long, processor string"
    spark.createDataFrame(rows, kinds).withColumn("at", F.timestamp_millis("ms")).coalesce(1).write.parquet(f"{folder}/{number}")


def commands(spark, folder, files=1):
    return spark.readStream.schema(lifecycle.COMMANDS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(folder)


def test_restart_between_micro_batches(spark):
    """One run over the whole log, one run a part of the log from where the last one stopped, and one micro-batch a file end alike."""
    log = [r.asDict() for r in events.commands_of(spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))).orderBy("ms", "seq").collect()]
    names = "batch_id item_id ms seq kind token expected faces processor".split()
    whole, parted, alike = (fresh_path(spark, n) for n in ("whole", "parted", "alike"))
    put(spark, whole, 0, [[r[n] for n in names] for r in log])
    want = sorted(map(tuple, lifecycle.states(commands(spark, whole)).collect()))
    sink, marks = fresh_path(spark, "sink"), fresh_path(spark, "marks")
    for k in range(3):
        part = [[r[n] for n in names] for r in log[k * len(log) // 3 : (k + 1) * len(log) // 3]]
        put(spark, parted, k, part)
        put(spark, alike, k, part)
        lifecycle.run(commands(spark, parted), sink, marks)
    assert sorted(map(tuple, lifecycle.latest(spark, sink).collect())) == want
    assert sorted(map(tuple, lifecycle.states(commands(spark, alike)).collect())) == want
    assert any(r[1] == "partial_failed" for r in want) and len(want) == 15


def test_timers(spark):
    """Without another command of its batch, a lease ends, an idle batch is sealed, and one that ended long ago is forgotten."""
    folder, day = fresh_path(spark, "commands"), 86_400_000
    base = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    row = lambda b, i, ms, n, kind: [b, i, base + ms, n, kind, None, None, None, None]
    put(spark, folder, 0, [row(1, 0, 0, 1, "create"), row(1, 5, 1, 2, "append"), row(1, 5, 2, 3, "start"), row(2, 0, 0, 4, "create"), row(3, 0, 0, 5, "create"), row(3, 0, 1, 6, "seal")])
    put(spark, folder, 1, [row(9, 0, day, 7, "create")])
    put(spark, folder, 2, [row(9, 0, FORGET_MS + 2 * day, 8, "create")])
    put(spark, folder, 3, [row(3, 0, FORGET_MS + 2 * day + 1, 9, "create")])
    found = {r.batch_id: r for r in lifecycle.states(commands(spark, folder)).collect()}
    assert (found[1].status, found[1].queued, found[1].processing, found[1].requeued, found[1].auto_sealed) == ("running", 1, 0, 1, 1)
    assert (found[2].status, found[2].auto_sealed) == ("cancelled", 1)
    assert (found[3].status, found[3].rejected) == ("receiving", 0)


@pytest.mark.parametrize("rows", [[], [[None, None, None, None, None, None, None, None, None]]])
def test_empty_and_null_commands(spark, rows):
    folder = fresh_path(spark, "commands")
    put(spark, folder, 0, rows)
    assert all(r.status is None and r.rejected == 1 for r in lifecycle.states(commands(spark, folder)).collect())


def test_long_numbers_nulls_and_commas(spark):
    """Numbers beyond 53 bits stay exact beside nulls, and kinds and processors with commas are unknown ones."""
    folder, long = fresh_path(spark, "commands"), (1 << 53) + 1
    row = lambda b, i, ms, kind, token=None, processor=None: [b, i, ms, ms, kind, token, None, None, processor]
    log = lambda b: [row(b, None, 1, "append"), row(b, long, 2, "create"), row(b, long, 3, "append"), row(b, long, 4, "claim", long), row(b, long, 5, "confirm", b), row(b, long, 6, "succeed,cpu"), row(b, long, 7, "start", b, "cpu,gpu")]
    put(spark, folder, 0, [row(None, None, 1, "create"), *log(long), *log(long - 1), *log(-7)])
    found = {r.batch_id: (r.status, r.total, r.rejected, r.processing, r.processor) for r in lifecycle.states(commands(spark, folder)).collect()}
    assert found == {None: (None, 0, 1, 0, None), long: ("receiving", 1, 2, 1, None), long - 1: ("receiving", 1, 3, 1, None), -7: ("receiving", 1, 3, 1, None)}


class Counted:
    """A state that counts the calls to it, as value, map and handle."""

    def __init__(self, calls):
        self.calls, self.kept = calls, {}

    def __getattr__(self, name):
        self.calls[name] += 1
        plain = {
            "get": lambda: self.kept.get(()), "exists": lambda: () in self.kept, "update": lambda x: self.kept.__setitem__((), x), "clear": self.kept.clear, "getValue": self.kept.get, "containsKey": self.kept.__contains__,
            "updateValue": self.kept.__setitem__, "removeKey": self.kept.pop, "registerTimer": lambda ms: None, "getValueState": lambda *a: Counted(self.calls), "getMapState": lambda *a: Counted(self.calls),
        }
        return plain[name]


def test_calls_of_the_state_do_not_grow_with_items_and_leases():
    """Sixty items of a batch, all started and ended within a micro-batch: few calls, and no timer for leases that are over."""
    calls = Counter()
    processor = lifecycle.Lifecycle()
    processor.init(Counted(calls))
    calls.clear()
    log = [("create", 0), *((k, i) for k in ("append", "start", "succeed") for i in range(60))]
    names = "item_id ms seq token expected faces kind processor".split()
    rows = pd.DataFrame([(i, n, n, None, None, 1, kind, "cpu") for n, (kind, i) in enumerate(log)], columns=names)
    rows["command"] = [f"{i},{n},{n},,,1,{kind},cpu" for n, (kind, i) in enumerate(log)]
    list(processor.handleInputRows((1,), iter([rows]), None))
    assert calls["registerTimer"] == 1 and sum(calls.values()) <= 4, calls
