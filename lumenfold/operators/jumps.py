"""Chains of jumps: each row names the row that follows it, and those that the first row of its key leads to are wanted.

This is how greedy windows and pages are cut: a row's successor (where the window or page that it would open ends) does not depend on where
the others open, so all successors are found by one ordered search, and only then the chain is followed. Rows are numbered from 1 within a
key and cut into blocks by their numbers. A block follows its own chains by doubling, on arrays; where a key has more than one block, a
second doubling, by joins, runs over the rows at which chains enter blocks. A key's rows are spread over as many tasks as it has blocks.

Keys that fit a block, mostly all of them, need none of this: they are dealt whole, about a block of rows to a group, and cut there, with one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators.scans import CHUNK, running, spread
from lumenfold.sources.storage import dropped, written

#: Rows of a key that one task follows at once.
BLOCK = 1 << 16


def successors(rows: DataFrame, key: list[str], number: str, value: Column, beyond: Column, keep: list[str]) -> DataFrame:
    """(key, keep, number, _next) of each row; _next: the number of the first row of the key whose value is `beyond` or more, one past the last where none is.

    rows: numbered from 1 in each key, in the order of the value.
    """
    own = rows.select(*key, *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep), F.lit(None).cast("long").alias(number), value.alias("_at"), F.lit(1).alias("_side"))
    back = rows.select(*key, *keep, number, beyond.alias("_at"), F.lit(0).alias("_side"))
    order = ["_at", "_side"]
    counted = running(spread(own.unionByName(back), key, order), key, order, _n=("sum", F.col("_side").cast("long")))
    return counted.where("_side = 0").select(*key, *keep, number, (F.col("_n") + 1).alias("_next"))


def _codes(table: pa.Table, key: list[str]) -> np.ndarray:
    """A number for each key of a table; null is a key."""
    code = np.zeros(table.num_rows, np.int64)
    for k in key:
        made = table.column(k).combine_chunks().dictionary_encode("encode")
        code = code * max(1, len(made.dictionary)) + made.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def _chained(on: np.ndarray, jump: np.ndarray) -> np.ndarray:
    """The places that the given ones lead to, themselves included; a chain ends at a place that leads to itself."""
    while True:
        on[jump[on]] = True
        far = jump[jump]
        if (far == jump).all():
            return on
        jump = far


def _places(table: pa.Table, key: list[str], number: str, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by key and number, and in that order: the numbers, and each row's place of its successor (its own where the block does not hold it)."""
    code = _codes(table, key)
    i, follow = table.column(number).to_numpy(), table.column("_next").to_numpy()
    order = np.lexsort((i, code))
    code, i, follow = code[order], i[order], follow[order]
    own = np.arange(len(i))
    there = own + follow - i  # numbers are dense within a block
    inside = np.minimum(there, len(i) - 1)
    ok = ((follow - 1) // block == (i - 1) // block) & (there < len(i)) & (code[inside] == code) & (i[inside] == follow)
    return order, i, np.where(ok, inside, own)


def _dealt(rows: DataFrame, key: list[str], number: str, block: int, groups: int) -> DataFrame:
    """rows with the group that holds their block: whole blocks, about `block` rows in a group."""
    part = F.floor((F.col(number) - 1) / block)
    return rows.withColumn("_group", F.pmod(F.xxhash64(*key, part), F.lit(groups)))


def _exits(rows: DataFrame, key: list[str], number: str, block: int, groups: int) -> DataFrame:
    """(key, number, _exit) of the rows whose chain leaves their block for another one; _exit: the first number there."""

    def leave(table: pa.Table) -> pa.Table:
        order, i, jump = _places(table, key, number, block)
        while True:
            far = jump[jump]
            if (far == jump).all():
                break
            jump = far
        out = table.column("_next").to_numpy()[order][jump]
        crossed = (out - 1) // block != (i - 1) // block
        rows_ = table.select([*key, number]).take(pa.array(order[crossed]))
        return rows_.append_column("_exit", pa.array(out[crossed], pa.int64()))

    schema = T.StructType([*(rows.schema[k] for k in key), T.StructField(number, T.LongType()), T.StructField("_exit", T.LongType())])
    return _dealt(rows.select(*key, number, "_next"), key, number, block, groups).groupBy("_group").applyInArrow(leave, schema)


def _entries(exits: DataFrame, key: list[str], number: str) -> DataFrame:
    """(_k, _a): the rows at which the chains from the first rows enter further blocks. Each round doubles the hops of all entries and then what is reached."""
    spark = exits.sparkSession
    named = exits.select(F.struct(*key).alias("_k"), F.col(number).alias("_i"), F.col("_exit").alias("hop"))
    goals = named.select(F.col("_k").alias("_gk"), F.col("hop").alias("_ga")).distinct()
    met = named.join(goals, (F.col("_k") == F.col("_gk")) & (F.col("_i") == F.col("_ga")), "left").where("_i = 1 or _gk is not null")
    state = written(met.select("_k", "_i", "hop", F.col("hop").alias("jump"), (F.col("_i") == 1).alias("on")), "entries")
    while state.where("jump is not null").limit(1).count():
        there = state.select(F.col("_k").alias("_tk"), F.col("_i").alias("_ta"), F.col("jump").alias("far"))
        marks = state.where("`on` and jump is not null").select(F.col("_k").alias("_mk"), F.col("jump").alias("_ma"))  # chains run forward, so no two marks of a key meet
        moved = state.join(there, (F.col("_k") == F.col("_tk")) & (F.col("jump") == F.col("_ta")), "left").join(marks, (F.col("_k") == F.col("_mk")) & (F.col("_i") == F.col("_ma")), "left")
        after = written(moved.select("_k", "_i", "hop", F.col("far").alias("jump"), (F.col("on") | F.col("_ma").isNotNull()).alias("on")), "entries")
        dropped(spark, state)
        state = after
    return state.where("`on`").select("_k", F.col("hop").alias("_a"))


def reached(rows: DataFrame, key: list[str], number: str = "_i", block: int = BLOCK) -> DataFrame:
    """rows of successors() with `_on`: whether the chain of the key's first row passes through this one."""
    rows = written(rows, "jumps")
    total, most = rows.agg(F.count("*"), F.max(number)).first()
    groups = max(1, -(-total // block))
    first = F.col(number) == 1
    if (most or 0) > block:
        into = _entries(written(_exits(rows, key, number, block, groups), "exits"), key, number)
        flagged = rows.join(into, (F.struct(*key) == F.col("_k")) & (F.col(number) == F.col("_a")), "left").withColumn("_on", first | F.col("_a").isNotNull()).drop("_k", "_a")
    else:
        flagged = rows.withColumn("_on", first)
    schema = flagged.schema

    def follow(table: pa.Table) -> pa.Table:
        order, _, jump = _places(table, key, number, block)
        on = _chained(table.column("_on").to_numpy(zero_copy_only=False)[order].astype(bool), jump)
        return table.select([c for c in schema.names if c != "_on"]).take(pa.array(order)).append_column("_on", pa.array(on)).select(schema.names)

    return _dealt(flagged, key, number, block, groups).groupBy("_group").applyInArrow(follow, schema)


def _whole(df: DataFrame, key: list[str], sort: list[str], groups: int, spans: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], reach: int | None, out: Callable[[np.ndarray, np.ndarray], pa.Array], schema: T.StructType) -> DataFrame:
    """Cuts keys that are dealt whole to groups.

    spans: of a table in the order of key and `sort`, and the place of the first row of each row's key: the values, and those that end what a row opens.
    reach: the most rows that a row opens, if bounded. out: the last column of the result, of the marks and of the place of each row's mark.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("_code", pa.array(_codes(table, key)))
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ["_code", *sort]], null_placement="at_start"))
        code, own = table.column("_code").to_numpy(), np.arange(table.num_rows)
        first, end = np.searchsorted(code, code, "left"), np.searchsorted(code, code, "right")
        value, beyond = spans(table, first)
        marks, rank = np.unique(np.concatenate([value, beyond]), return_inverse=True)
        size = len(marks) + 1
        follow = np.searchsorted(code * size + rank[: len(own)], code * size + rank[len(own) :], "left")
        if reach is not None:
            follow = np.minimum(follow, own + reach)
        follow = np.maximum(follow, own + 1)
        on = _chained(own == first, np.where(follow < end, follow, own))
        return table.select(schema.names[:-1]).append_column(schema.names[-1], out(on, np.maximum.accumulate(np.where(on, own, 0)), first))

    return df.withColumn("_group", F.pmod(F.xxhash64(*key), F.lit(groups))).groupBy("_group").applyInArrow(run, schema)


def _by_size(df: DataFrame, key: list[str], block: int, small: Callable[[DataFrame, int], DataFrame], large: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """small() of the keys that fit a block, large() of the others."""
    counts = df.groupBy(*key).agg(F.count("*").alias("_rows"))
    total, most = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    groups = max(1, -(-(total or 0) // block), min((total or 0) // 1024, df.sparkSession.sparkContext.defaultParallelism))
    if (most or 0) <= block:
        return small(df, groups)
    hot = written(counts.where(F.col("_rows") > block).select(F.struct(*key).alias("_k")), "large")
    told = df.withColumn("_own", F.struct(*key))
    mine = F.col("_own") == F.col("_k")
    return small(told.join(hot, mine, "left_anti").drop("_own"), groups).unionByName(large(told.join(hot, mine, "left_semi").drop("_own")))


def anchored_windows(df: DataFrame, key: list[str], time: str, item: str, seconds: int, limit: int, block: int = BLOCK) -> DataFrame:
    """(key, item, allowed) with windows of so many seconds that start at a hit: the first hit after a window opens the next; hits beyond the limit are refused and do not extend it.

    time: epoch microseconds. Hits without one come first, as a window of their own that ends with the first hit that has a time. Hits of equal time are taken by item.
    """
    never, width = -(1 << 63), seconds * 1_000_000
    named = df.select(*key, item, F.coalesce(time, F.lit(never)).alias("_t"))
    order = ["_t", item]

    def spans(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = table.column("_t").to_numpy()
        return t, np.where(t == never, never + 1, t + width)

    def small(part: DataFrame, groups: int) -> DataFrame:
        schema = T.StructType([*(part.schema[c] for c in [*key, item]), T.StructField("allowed", T.BooleanType())])
        return _whole(part, key, order, groups, spans, None, lambda on, mark, first: pa.array(np.arange(len(on)) - mark < limit), schema)

    def large(part: DataFrame) -> DataFrame:
        rows = running(spread(part, key, order), key, order, _i=("sum", F.lit(1).cast("long"))).drop(CHUNK)
        ends = F.when(F.col("_t") == never, F.col("_t") + 1).otherwise(F.col("_t") + width)
        path = reached(successors(written(rows, "numbered"), key, "_i", F.col("_t"), ends, [item]), key, block=block)
        found = running(spread(path, key, ["_i"]), key, ["_i"], _start=("max", F.when(F.col("_on"), F.col("_i"))))
        return found.select(*key, item, (F.col("_i") - F.col("_start") < limit).alias("allowed"))

    return _by_size(named, key, block, small, large)


def pages(df: DataFrame, key: list[str], item: str, size: str, files: int, most: int, block: int = BLOCK) -> DataFrame:
    """(key, item, page): the rows of a key, in the order of item, packed into pages from 0 of at most so many rows and a sum of sizes of `most`; a larger row has a page of its own.

    size: a whole number; null and negative sizes count as 0. Rows of equal item are taken by size.
    """
    named = df.select(*key, item, F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0).cast("long")).alias("_z"))
    order = [item, "_z"]

    def spans(table: pa.Table, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = table.column("_z").to_numpy()
        total = np.cumsum(z)
        upto = total - total[first] + z[first]
        return upto, upto - z + most + 1

    def numbers(on: np.ndarray, mark: np.ndarray, first: np.ndarray) -> pa.Array:
        opened = np.cumsum(on)
        return pa.array((opened - opened[first]).astype(np.int32))

    def small(part: DataFrame, groups: int) -> DataFrame:
        return _whole(part, key, order, groups, spans, files, numbers, T.StructType([*(part.schema[c] for c in [*key, item]), T.StructField("page", T.IntegerType())]))

    def large(part: DataFrame) -> DataFrame:
        rows = running(spread(part, key, order), key, order, _i=("sum", F.lit(1).cast("long")), _sum=("sum", F.col("_z"))).drop(CHUNK)
        full = successors(written(rows, "numbered"), key, "_i", F.col("_sum"), F.col("_sum") - F.col("_z") + most + 1, [item])
        follow = F.greatest(F.col("_i") + 1, F.least(F.col("_i") + files, "_next"))
        path = reached(full.withColumn("_next", follow), key, block=block)
        found = running(spread(path, key, ["_i"]), key, ["_i"], _page=("sum", F.when(F.col("_on"), F.lit(1).cast("long"))))
        return found.select(*key, item, (F.col("_page") - 1).cast("int").alias("page"))

    return _by_size(named, key, block, small, large)
