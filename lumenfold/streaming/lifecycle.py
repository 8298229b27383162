"""Life cycle of batches and their items, as keyed state with timers.

Commands of a batch arrive as a stream: create, append, seal, claim, confirm, start, retry, succeed, fail, skip, cancel, finalize.
The state of a batch is one row of counters, a map of its items by pages of ids, and a map of the leases that end at a time; event-time timers
seal a batch that has received nothing for six hours, put items whose lease of 17 minutes is over back to the queue, and forget
a batch 30 days after its end. A command finds the state as it is at its own time, whether or not the watermark has reached a timer before it, so
neither the cuts between micro-batches nor a restart changes the result.

States: a batch is receiving, running, finalizing, then completed, partial_failed or failed; or cancelled. An item is queued, processing, then
succeeded, failed, skipped or cancelled. A command that its state forbids changes nothing but the count of rejected ones; so does one that comes after a later
one of its batch, a repeated append, or an unknown kind. Commands without a batch, item, time or number are rejected likewise; an empty stream has no batches.

A command crosses to Python as a line of text and a batch comes back as one, as each column costs time for each batch; each call of the state costs as much as many commands, so few are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenfold.sources.storage import fresh_path

LEASE_MS, IDLE_MS, FORGET_MS = 17 * 60_000, 6 * 3_600_000, 30 * 86_400_000
LATE = "10 minutes"
#: Ids of items that one entry of the state's map holds.
PAGE = 64
#: What a command holds.
COMMANDS = "batch_id long, item_id long, at timestamp, ms long, seq long, kind string, token long, expected long, faces long, processor string"
TERMINAL = {"succeed": "succeeded", "fail": "failed", "skip": "skipped", "cancel": "cancelled"}
OF_ITEM = ("append", "claim", "confirm", "start", "retry")
RUNNING = ("receiving", "running", "finalizing")
ENDED = ("completed", "partial_failed", "failed", "cancelled")
PROCESSORS = ("cpu", "gpu")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Batch:
    """Counters of a batch; status is null before it is created."""

    status: str | None = None
    expected: int | None = None
    total: int = 0
    completed: int = 0
    succeeded: int = 0
    failed: int = 0
    skipped: int = 0
    faces: int = 0
    processor: str | None = None
    queued: int = 0
    processing: int = 0
    attempts: int = 0
    requeued: int = 0
    auto_sealed: int = 0
    rejected: int = 0
    last_ms: int = 0
    clock_ms: int = -(1 << 62)
    clock_seq: int = 0
    idle_timer: int | None = None
    forget_timer: int | None = None
    version: int = 0


TYPES = {"status": "string", "processor": "string"}
BATCH = ", ".join(f"{f.name} {TYPES.get(f.name, 'long')}" for f in fields(Batch))
SHOWN = [f.name for f in fields(Batch) if f.name not in ("clock_ms", "clock_seq", "idle_timer", "forget_timer")]
OUT = "batch_id long, " + ", ".join(f"{n} {TYPES.get(n, 'long')}" for n in SHOWN)


@dataclass
class Item:
    """An item; token: of the claim that dispatched it; since_ms: when it was claimed or started."""

    status: str
    token: int | None = None
    since_ms: int | None = None


ITEMS = "item_id array<long>, status array<string>, token array<long>, since_ms array<long>"


class Machine:
    """One batch while its commands are applied. items: item by id, or None; leases(ms, id) is told of each lease's end."""

    def __init__(self, batch: Batch, item: Callable[[int], Item | None], put: Callable[[int, Item], None], lease: Callable[[int, int], None], lease_ms: int, idle_ms: int) -> None:
        self.batch, self.item, self.put, self.lease, self.lease_ms, self.idle_ms = batch, item, put, lease, lease_ms, idle_ms

    def idle_until(self) -> int | None:
        """When the batch will be sealed for being idle."""
        return self.batch.last_ms + self.idle_ms + 1 if self.batch.status == "receiving" else None

    def advance(self, now: int) -> None:
        """Seal the batch if it has been idle for too long by now."""
        due = self.idle_until()
        if due is not None and due <= now:
            b = self.batch
            b.expected, b.last_ms, b.auto_sealed = b.total, due, b.auto_sealed + 1
            b.status = "cancelled" if b.total == 0 else self._after_receiving()

    def expire(self, key: int, now: int) -> Item | None:
        """The item as it is by now: processing items whose lease is over are queued again."""
        item = self.item(key)
        if item and item.status == "processing" and item.since_ms + self.lease_ms + 1 <= now:
            item = Item("queued")
            self.put(key, item)
            self.batch.queued, self.batch.processing, self.batch.requeued = self.batch.queued + 1, self.batch.processing - 1, self.batch.requeued + 1
        return item

    def _after_receiving(self) -> str:
        return "finalizing" if self.batch.completed >= self.batch.total else "running"

    def _merge(self, processor: str | None) -> None:
        if processor in PROCESSORS:
            self.batch.processor = processor if self.batch.processor in (None, processor) else "mixed"

    def apply(self, kind: str, key: int, now: int, seq: int, token: int | None, expected: int | None, faces: int | None, processor: str | None) -> None:
        """One command."""
        b = self.batch
        if (now, seq) <= (b.clock_ms, b.clock_seq):
            b.rejected += 1
            return
        b.clock_ms, b.clock_seq = now, seq
        self.advance(now)
        if kind in ("create", "seal", "finalize"):
            fine = getattr(self, f"_{kind}")(now, expected)
        else:
            item = self.expire(key, now)
            fine = self._finish(kind, key, item, now, faces, processor) if kind in TERMINAL else kind in OF_ITEM and getattr(self, f"_{kind}")(key, item, now, token, processor)
        b.rejected += not fine

    def _create(self, now: int, expected: int | None) -> bool:
        b = self.batch
        if b.status is not None:
            return False
        b.status, b.expected, b.last_ms = "receiving", None if expected is None else max(0, expected), now
        return True

    def _seal(self, now: int, _: int | None) -> bool:
        b = self.batch
        if b.status == "receiving":
            b.status, b.last_ms = "completed" if b.total == 0 else self._after_receiving(), now
        return b.status not in (None, "cancelled")

    def _finalize(self, now: int, _: int | None) -> bool:
        b = self.batch
        if b.status != "finalizing":
            return False
        b.status, b.last_ms = "failed" if b.failed >= b.total else "partial_failed" if b.failed else "completed", now
        return True

    def _append(self, key: int, item: Item | None, now: int, token: int | None, processor: str | None) -> bool:
        b = self.batch
        if b.status != "receiving" or item:
            return False
        self.put(key, Item("queued"))
        b.total, b.queued, b.last_ms = b.total + 1, b.queued + 1, now
        return True

    def _claim(self, key: int, item: Item | None, now: int, token: int | None, processor: str | None) -> bool:
        if not item or item.status != "queued" or (item.token is not None and item.since_ms + self.lease_ms >= now):
            return False
        self.put(key, Item("queued", token, now))
        return True

    def _confirm(self, key: int, item: Item | None, now: int, token: int | None, processor: str | None) -> bool:
        """A claim is finished only by its own token; the token is then that of nobody."""
        if not item or item.status != "queued" or item.token is None or item.token != token:
            return False
        self.put(key, Item("queued", -1, now))
        return True

    def _start(self, key: int, item: Item | None, now: int, token: int | None, processor: str | None) -> bool:
        b = self.batch
        if not item or item.status != "queued":
            return False
        self.put(key, Item("processing", token, now))
        self.lease(now + self.lease_ms + 1, key)
        b.queued, b.processing, b.attempts = b.queued - 1, b.processing + 1, b.attempts + 1
        if b.status in RUNNING:
            b.status, b.last_ms = "receiving" if b.status == "receiving" else "running", now
            self._merge(processor)
        return True

    def _retry(self, key: int, item: Item | None, now: int, token: int | None, processor: str | None) -> bool:
        if not item or item.status != "processing":
            return False
        self.put(key, Item("queued"))
        self.batch.queued, self.batch.processing = self.batch.queued + 1, self.batch.processing - 1
        return True

    def _finish(self, kind: str, key: int, item: Item | None, now: int, faces: int | None, processor: str | None) -> bool:
        """Whatever state the batch is in; one that is over opens again."""
        b = self.batch
        if not item or item.status not in ("queued", "processing"):
            return False
        setattr(b, item.status, getattr(b, item.status) - 1)
        self.put(key, Item(TERMINAL[kind]))
        b.completed, b.last_ms = b.completed + 1, now
        b.succeeded, b.failed, b.skipped = b.succeeded + (kind == "succeed"), b.failed + (kind == "fail"), b.skipped + (kind in ("skip", "cancel"))
        b.faces += max(0, faces or 0)
        if b.status != "receiving" or b.expected is not None and b.total >= b.expected:
            b.status = self._after_receiving()
        self._merge(processor)
        return True


def read(line: str) -> tuple:
    """(item, ms, seq, token, expected, faces, kind, processor) of a line of packed()."""
    *numbers, kind, processor = line.split(",")
    return *(int(x) if x else None for x in numbers), kind, processor or None


def in_order(command: tuple) -> tuple:
    """By time and number; those without one come last."""
    _, ms, seq, *_ = command
    return ms is None, ms or 0, seq is None, seq or 0


class Lifecycle(StatefulProcessor):
    """State of one batch in Spark. A page of items is read when a command first names one of them and written once a micro-batch; a batch that is new has nothing to read."""

    def __init__(self, lease_ms: int = LEASE_MS, idle_ms: int = IDLE_MS, forget_ms: int = FORGET_MS) -> None:
        self.lease_ms, self.idle_ms, self.forget_ms = lease_ms, idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.batch = handle.getValueState("batch", BATCH)
        self.items = handle.getMapState("items", "page long", ITEMS)
        self.leases = handle.getMapState("leases", "ms long", "items array<long>")

    def _open(self, held: tuple | None) -> tuple[Machine, dict[int, dict[int, Item]], set[int], dict[int, list[int]]]:
        """The machine of a batch, its pages as they are read, the pages that have changed, and the leases given."""
        pages: dict[int, dict[int, Item]] = {}
        changed: set[int] = set()
        ends: dict[int, list[int]] = {}

        def page(number: int) -> dict[int, Item]:
            if number not in pages:
                kept = self.items.getValue((number,)) if held else None
                pages[number] = {i: Item(*x) for i, *x in zip(*kept, strict=True)} if kept else {}
            return pages[number]

        def put(key: int, item: Item) -> None:
            page(key // PAGE)[key] = item
            changed.add(key // PAGE)

        def lease(ms: int, key: int) -> None:
            ends.setdefault(ms, []).append(key)

        return Machine(Batch(*held) if held else Batch(), lambda key: page(key // PAGE).get(key), put, lease, self.lease_ms, self.idle_ms), pages, changed, ends

    def _over(self, batch: Batch, now: int) -> bool:
        return batch.status in ENDED and batch.last_ms + self.forget_ms <= now

    def _forget(self) -> None:
        for state in (self.batch, self.items, self.leases):
            state.clear()

    def _close(self, key: tuple, held: tuple | None, machine: Machine, pages: dict[int, dict[int, Item]], changed: set[int], ends: dict[int, list[int]]) -> Iterator[pd.DataFrame]:
        b = machine.batch
        for number in changed:
            rows = [(i, *astuple(item)) for i, item in pages[number].items()]
            self.items.updateValue((number,), tuple(map(list, zip(*rows, strict=True))))
        for ms, ids in ends.items():
            running = [i for i in dict.fromkeys(ids) if (item := machine.item(i)) and item.status == "processing" and item.since_ms + self.lease_ms + 1 == ms]
            if running:
                before = self.leases.getValue((ms,)) if held else None
                self.leases.updateValue((ms,), ([*(before[0] if before else ()), *running],))
                self.handle.registerTimer(ms)
        if b.idle_timer is None and machine.idle_until() is not None:
            b.idle_timer = machine.idle_until()
            self.handle.registerTimer(b.idle_timer)
        if b.forget_timer is None and b.status in ENDED:
            b.forget_timer = b.last_ms + self.forget_ms
            self.handle.registerTimer(b.forget_timer)
        b.version += 1
        self.batch.update(astuple(b))
        yield pd.DataFrame({"line": [",".join("" if x is None else str(x) for x in (key[0], *(getattr(b, n) for n in SHOWN)))]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.batch.get()
        opened = self._open(held)
        for item, ms, seq, token, expected, faces, kind, processor in sorted((read(line) for part in rows for line in part["command"].tolist()), key=in_order):
            if item is None or ms is None or seq is None:
                opened[0].batch.rejected += 1
            else:
                if self._over(opened[0].batch, ms):
                    self._forget()
                    held = None
                    opened = self._open(held)
                opened[0].apply(kind, item, ms, seq, token, expected, faces, processor)
        yield from self._close(key, held, *opened)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = self.batch.get()
        if held is None:  # forgotten since
            return
        opened = self._open(held)
        machine = opened[0]
        b = machine.batch
        if b.forget_timer is not None and b.forget_timer <= now:
            if self._over(b, now):
                self._forget()
                return
            b.forget_timer = None
        if b.idle_timer is not None and b.idle_timer <= now:
            machine.advance(now)
            b.idle_timer = None
        ended = self.leases.getValue((now,))
        if ended:
            for item in ended[0]:
                machine.expire(item, now)
            self.leases.removeKey((now,))
        yield from self._close(key, held, *opened)

    def close(self) -> None:
        """Nothing is held beside the state."""


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State that a processor keeps under several names needs this store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def packed() -> Column:
    """A command as a line of text: its numbers, then kind and processor where they are known."""
    numbers = [F.col(n).cast("string") for n in ("item_id", "ms", "seq", "token", "expected", "faces")]
    kind = F.when(F.col("kind").isin("create", "seal", "finalize", *OF_ITEM, *TERMINAL), F.col("kind"))
    processor = F.when(F.col("processor").isin(*PROCESSORS), F.col("processor"))
    return F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in (*numbers, kind, processor)))


def run(commands: DataFrame, sink: str, marks: str, **limits: int) -> None:
    """Apply a stream of COMMANDS to its end: changed batches go to the table sink, progress to marks, so that another call goes on where this one ended."""

    def put(rows: DataFrame, number: int) -> None:
        parts = F.split("line", ",")
        shown = rows.select(*(F.nullif(parts[i], F.lit("")).cast(TYPES.get(n, "long")).alias(n) for i, n in enumerate(("batch_id", *SHOWN))))
        shown.write.mode("overwrite").parquet(f"{sink}/micro_batch={number}")  # a repeated micro-batch replaces itself

    lines = commands.select(F.col("batch_id").cast("string").alias("batch"), "at", packed().alias("command")).withWatermark("at", LATE)
    changed = lines.groupBy("batch").transformWithStateInPandas(Lifecycle(**limits), "line string", "Update", "EventTime")
    with rocksdb(commands.sparkSession):
        changed.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """Each batch as it stood last."""
    rows = spark.read.schema(f"{OUT}, micro_batch long").parquet(sink)
    return rows.groupBy("batch_id").agg(F.max_by(F.struct(*SHOWN), F.struct("micro_batch", "version")).alias("x")).select("batch_id", "x.*").drop("version")


def states(commands: DataFrame, **limits: int) -> DataFrame:
    """Each batch after all commands of a stream."""
    spark = commands.sparkSession
    sink = fresh_path(spark, "sink")
    run(commands, sink, fresh_path(spark, "marks"), **limits)
    return latest(spark, sink)
