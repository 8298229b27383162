"""Approximate nearest neighbours: a navigable small-world graph for each shard, results merged.

Equal vectors are one point of the index that keeps the smallest ids, as many as a query can need.
A hash deals the points to shards of bounded size. A task builds a shard's graph and keeps it as flat
arrays: for each layer the members and a block of neighbour positions. A second job sends blocks of queries
to bundles of shards, searches each shard, scores in double precision on the original vectors and keeps each
query's best; a window over these merges the shards. Neither side is collected or broadcast: the join
says so itself, as Spark takes the blocks for as large as they are before they are sent to each bundle.

The graph: a point's top layer falls geometrically with a hash of its place; points are linked to near ones
that are not nearer to one already chosen. Points enter in blocks, which see the graph before them
and each other; searches run for many queries at once, one expansion of each in a step.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors of another length than the most frequent; with fewer than k candidates all come back; ties go to the
smaller id; rows that repeat an id with the same vector are one candidate; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import small_batches, written

LINKS = 16
BUILD = 48
SEARCH = 96
SHARD = 4_096
QUERY_BLOCK = 1_024
#: Bundles of shards that a block of queries is sent to, at most, while a bundle has no more than TOGETHER shards.
BUNDLES = 64
#: Shards of a bundle, at most: a task of the join holds a bundle.
TOGETHER = 16


def _top(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row, in order."""
    if dist.shape[1] > k:
        part = np.argpartition(dist, k - 1, axis=1)[:, :k]
        ids, dist = np.take_along_axis(ids, part, 1), np.take_along_axis(dist, part, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


class Graph:
    """Layers of flat neighbour arrays over unit vectors; distance is one minus the dot product."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, build: int = BUILD) -> None:
        self.unit, self.links, self.build = unit, links, build
        n = len(unit)
        draw = np.random.default_rng(7).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")  # high layers enter first
        self.level = level
        self.layers = [np.full((n if d == 0 else int((level >= d).sum()), 2 * links if d == 0 else links), -1, np.int32) for d in range(int(level.max(initial=0)) + 1)]
        self.place = np.empty(n, np.int64)  # position in the order; a layer's members are a prefix of it
        self.place[self.order] = np.arange(n)
        self.unit = unit[self.order]
        at = 0
        while at < n:
            size = max(1, min(256, at))
            self._enter(at, min(n, at + size))
            at += size

    def _search(self, query: np.ndarray, start: np.ndarray, layer: int, wide: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `wide` places below limit that a best-first walk of the layer finds for each query."""
        table, count = self.layers[layer], len(query)
        ids = np.full((count, wide), -1, np.int64)
        dist = np.full((count, wide), np.inf, np.float32)
        closed = np.ones((count, wide), bool)
        k = start.shape[1]
        ids[:, :k] = start
        known = start >= 0
        dist[:, :k] = np.where(known, 1 - np.einsum("qd,qkd->qk", query, self.unit[np.maximum(start, 0)]), np.inf)
        closed[:, :k] = ~known
        seen = np.zeros((count, limit + 1), bool)
        seen[np.arange(count)[:, None], np.where(known, start, limit)] = True
        row = np.arange(count)
        while len(row):
            waiting = np.where(closed[row], np.inf, dist[row])
            pick = waiting.argmin(1)
            going = np.isfinite(waiting[np.arange(len(row)), pick])
            row, pick = row[going], pick[going]
            if not len(row):
                break
            closed[row, pick] = True
            near = table[ids[row, pick]].astype(np.int64)
            near[(near >= limit) | (near < 0)] = limit
            fresh = ~seen[row[:, None], near]
            fresh &= near < limit
            seen[row[:, None], near] = True
            near = np.where(fresh, near, 0)
            d = np.where(fresh, 1 - np.einsum("qd,qkd->qk", query[row], self.unit[near]), np.inf).astype(np.float32)
            all_ids, all_dist = np.concatenate([ids[row], near], 1), np.concatenate([dist[row], d], 1)
            all_closed = np.concatenate([closed[row], ~fresh], 1)
            best = np.argpartition(all_dist, wide - 1, axis=1)[:, :wide]
            ids[row], dist[row], closed[row] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_closed))
        return _top(ids, dist, wide)

    def _chosen(self, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, near to far, those that are nearer to the point than to any chosen before; then the nearest rest."""
        count, width = ids.shape
        vec = self.unit[np.maximum(ids, 0)]
        between = 1 - np.einsum("qad,qbd->qab", vec, vec)
        usable = np.isfinite(dist) & (ids >= 0)
        taken = np.zeros((count, width), bool)
        left = np.full(count, most)
        for i in range(width):
            clash = (taken & (between[:, i, :] < dist[:, i, None])).any(1)
            good = usable[:, i] & ~clash & (left > 0)
            taken[:, i] = good
            left -= good
        rank = np.where(taken, 0, np.where(usable, 1, 2)) * width + np.arange(width)
        pick = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(ids, pick, 1)
        out[~np.take_along_axis(usable, pick, 1)] = -1
        return out

    def _enter(self, first: int, last: int) -> None:
        query = self.unit[first:last]
        count = last - first
        inner = 1 - query @ query.T
        np.fill_diagonal(inner, np.inf)
        levels = self.level[self.order[first:last]]
        start = np.zeros((count, 1), np.int64) if first else np.full((count, 1), -1, np.int64)
        for layer in range(len(self.layers) - 1, -1, -1):
            inside = min(first, len(self.layers[layer]))
            if inside:
                ids, dist = self._search(query, np.where(start < inside, start, 0), layer, self.build if layer <= levels.max() else 1, inside)
            else:
                ids, dist = np.full((count, 1), -1, np.int64), np.full((count, 1), np.inf, np.float32)
            start = ids[:, :8]
            join = np.flatnonzero(levels >= layer)
            if not len(join):
                continue
            peers = np.where(levels >= layer, inner[join], np.inf)
            near, far = _top(np.broadcast_to(np.arange(first, last), peers.shape), peers, min(16, count))
            near = np.where(np.isfinite(far), near, -1)
            both_ids, both = np.concatenate([ids[join], near], 1), np.concatenate([dist[join], far], 1)
            order = np.argsort(both, axis=1, kind="stable")[:, : self.build]
            links = self._chosen(np.take_along_axis(both_ids, order, 1), np.take_along_axis(both, order, 1), self.links)
            self._link(layer, join + first, links)

    def _link(self, layer: int, points: np.ndarray, links: np.ndarray) -> None:
        """Link points to theirs and back; a full block is chosen anew."""
        table = self.layers[layer]
        table[points, : links.shape[1]] = links
        source = np.repeat(points, links.shape[1])
        target = links.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        owner, begin = np.unique(target, return_index=True)
        groups = np.split(source, begin[1:])
        most = max(map(len, groups), default=0)
        if not most:
            return
        extra = np.full((len(owner), most), -1, np.int64)
        for i, g in enumerate(groups):
            extra[i, : len(g)] = g
        wide = np.concatenate([table[owner].astype(np.int64), extra], 1)
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
        count = (wide >= 0).sum(1)
        wide = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
        width = table.shape[1]
        fits = count <= width
        table[owner[fits]] = wide[fits, :width] if wide.shape[1] >= width else np.pad(wide[fits], ((0, 0), (0, width - wide.shape[1])), constant_values=-1)
        full = np.flatnonzero(~fits)
        for i in range(0, len(full), 256):
            part = full[i : i + 256]
            ids = wide[part, : count[part].max()]
            dist = np.where(ids >= 0, 1 - np.einsum("qd,qkd->qk", self.unit[owner[part]], self.unit[np.maximum(ids, 0)]), np.inf)
            ids, dist = _top(ids, dist, ids.shape[1])
            table[owner[part]] = self._chosen(ids, dist, width)

    def search(self, query: np.ndarray, k: int, wide: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k nearest found for each unit query, as positions of the input, and their distances."""
        n = len(self.unit)
        start = np.zeros((len(query), 1), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self._search(query, start, layer, 8, len(self.layers[layer]))[0][:, :8]
        ids, dist = self._search(query, start, 0, max(wide, k), n)
        return np.where(ids[:, :k] >= 0, self.order[np.maximum(ids[:, :k], 0)], -1), dist[:, :k]

    def packed(self) -> dict[str, bytes]:
        """The graph as flat arrays."""
        return {"order": self.order.astype("<i4").tobytes(), "sizes": np.array([x.shape for x in self.layers], "<i4").tobytes(), "links": b"".join(x.astype("<i4").tobytes() for x in self.layers)}

    @classmethod
    def unpacked(cls, unit: np.ndarray, order: bytes, sizes: bytes, links: bytes) -> Graph:
        """The graph of these arrays over the same vectors."""
        self = cls.__new__(cls)
        self.order = np.frombuffer(order, "<i4").astype(np.int64)
        self.unit = unit[self.order]
        flat, at, self.layers = np.frombuffer(links, "<i4"), 0, []
        for rows, width in np.frombuffer(sizes, "<i4").reshape(-1, 2):
            self.layers.append(flat[at : at + rows * width].reshape(rows, width))
            at += rows * width
        return self


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither overflow nor vanish; directions stay exactly as they are."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw / np.linalg.norm(raw, axis=1, keepdims=True), np.float32)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part; floats stay floats, as wider ones would double what is shuffled, all else is array<double>."""
    single = df.select(vector).schema[0].dataType.simpleString() == "array<float>"
    vec = F.col(vector) if single else F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vec, lambda x: x != 0)).select(F.col(key).alias("id"), vec.alias("vec"))
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == length[0][0]) if length else rows


def _hashed() -> Column:
    """A hash of the vector, the same for floats and doubles."""
    return F.xxhash64(F.col("vec").cast("array<double>"))


def build(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, ids, vectors, order, sizes, links): a row for each shard. rows: (id, vec), each once; vectors go out as they came in."""
    schema = "shard int, n int, ids binary, counts binary, vectors binary, `order` binary, sizes binary, links binary"

    def one(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype("<i8")
        raw = pc.list_flatten(table.column("vec")).to_numpy().reshape(len(ids), -1) + 0  # no negative zeros
        by = np.argsort(ids, kind="stable")
        ids, raw = ids[by], raw[by]
        _, first, point = np.unique(raw, axis=0, return_index=True, return_inverse=True)
        point = np.argsort(np.argsort(first))[point.ravel()]  # points in the order of their smallest ids
        vec, ids = raw[np.sort(first)], ids[np.argsort(point, kind="stable")]
        graph = Graph(_unit(_scaled(vec.astype(np.float64)))).packed()
        row = {"shard": table.column("shard")[0].as_py(), "n": len(vec), "ids": ids.tobytes(), "counts": np.bincount(point).astype("<i4").tobytes(), "vectors": vec.astype(vec.dtype.newbyteorder("<")).tobytes(), **graph}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("n", pa.int32()), *((k, pa.binary()) for k in ("ids", "counts", "vectors", "order", "sizes", "links"))]))

    dealt = rows.select("id", "vec", F.pmod(_hashed(), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInArrow(one, schema)


def bundles(shards: int) -> int:
    """How many bundles so many shards make."""
    return min(shards, max(BUNDLES, -(-shards // TOGETHER)))


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, wide: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of is_query (a condition on `id`) among all other rows."""
    rows = usable(df, key, vector)
    first = F.row_number().over(W.partitionBy("vec").orderBy("id"))
    kept = rows.distinct().withColumn("_n", first).where(F.col("_n") <= k + 1)  # no query can need more of equal vectors
    points = rows.select(_hashed().alias("h")).distinct().count()
    shards = max(1, -(-points // shard))
    index = written(build(kept, shards), "shards")
    kind = "<f4" if rows.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"
    queries = rows.where(is_query).distinct()
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("asked"))
    lots = bundles(shards)
    sent = asked.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    held = index.withColumn("bundle", F.pmod("shard", F.lit(lots)))
    pairs = sent.repartition(lots, "bundle").hint("merge").join(held.repartition(lots, "bundle"), "bundle")  # as many tasks: they take long for their bytes

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                vec = _scaled(np.frombuffer(row["vectors"], kind).reshape(row["n"], -1).astype(np.float64))
                graph = Graph.unpacked(_unit(vec), row["order"], row["sizes"], row["links"])
                counts = np.frombuffer(row["counts"], "<i4")
                ends = np.cumsum(counts)
                ids = np.frombuffer(row["ids"], "<i8")
                query = _scaled(np.array([q["vec"] for q in row["asked"]], np.float64))
                own = np.array([q["id"] for q in row["asked"]], np.int64)
                found, _ = graph.search(_unit(query), min(k + 1, row["n"]), wide)
                out: list[tuple] = []
                norm = np.sqrt((vec * vec).sum(1))
                for q, near in zip(range(len(own)), found, strict=True):
                    near = near[near >= 0]
                    score = (vec[near] * query[q]).sum(1) / (norm[near] * np.sqrt((query[q] * query[q]).sum()))
                    hits = [(-s, int(v), int(own[q])) for p, s in zip(near.tolist(), score.tolist(), strict=True) for v in ids[ends[p] - counts[p] : ends[p]] if v != own[q]]
                    out += sorted(hits)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([-x[0] for x in out], pa.float64())], ["query_id", "vec_id", "score"])

    hits = pairs.transform(small_batches).mapInArrow(look, "query_id long, vec_id long, score double")
    best = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))  # equal hits share a rank
    return hits.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()
