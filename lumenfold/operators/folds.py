"""Order-dependent folds over a key's sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def carried(df: DataFrame, key: list[str], order: list[str], values: list[str], step: Callable[[tuple | None, tuple], tuple[tuple, tuple]], out: T.StructType) -> DataFrame:
    """(key, out): what step makes of each row, in the key's order, from the state after the row before (None at first) and the row's values.

    step gives (state, row). A key's rows pass through one task as a sorted stream of which a batch and one
    state are in memory, so a hot key costs time there, not space.
    """
    rows = df.select(*dict.fromkeys([*key, *order, *values])).repartition(*key).sortWithinPartitions(*key, *order)
    schema = T.StructType([*(df.schema[k] for k in key), *out.fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state = None, None
        for batch in batches:
            made = []
            keys = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            for name, row in zip(keys, zip(*(batch.column(v).to_pylist() for v in values), strict=True), strict=True):
                if name != owner:
                    owner, state = name, None
                state, x = step(state, row)
                made.append(x)
            fresh = [pa.array([x[i] for x in made], kinds.field(f.name).type) for i, f in enumerate(out.fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *fresh], [*key, *out.names])

    return rows.mapInArrow(run, schema)


def autoscaled(df: DataFrame, key: list[str], time: str, ceiling: int = 4) -> DataFrame:
    """(key, t, processes, reason) of a worker pool over its samples (cpu, queue).

    Pressure (cpu of 92 or more) takes a process away; a queue shorter than the pool for 20 s does too, 30 s after the last change;
    three healthy samples in a row with more work than processes add one, 15 s after the last change. time: seconds.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        (n, good, idle, changed), (t, cpu, queue) = state or (1, 0, None, None), row
        healthy = cpu is not None and queue is not None and cpu < 92
        quiet = lambda s: changed is None or t - changed >= s
        idle = (t if idle is None else idle) if healthy and queue < n else None
        good = good + 1 if healthy and n < min(queue, ceiling) else 0
        reason, move = "hold", 0
        if cpu is not None and cpu >= 92 and n > 1:
            reason, move = "cpu_busy", -1
        elif idle is not None and n > 1 and t - idle >= 20 and quiet(30):
            reason, move = "idle", -1
        elif good >= 3 and quiet(15):
            reason, move = "grow", 1
        n += move
        return (n, 0, None, t) if move else (n, good, idle, changed), (t, n, reason)

    return carried(df, key, [time, "cpu", "queue"], [time, "cpu", "queue"], step, T.StructType.fromDDL("t long, processes int, reason string"))
