"""Constrained greedy merging of groups, in rounds that each decide many edges at once.

The contract is a scan: edges by (distance, left, right), each joins the groups of its ends unless a photo is in both
or some pair across them is too far apart. A rejection is final, as groups only grow. So an edge may be decided as soon as no smaller open edge touches either
of its groups, wherever it stands in the scan, and every round decides all such edges: the smallest edge of all is among them.

A group that many others want (copies of one face, say) would still take one of them a round. Such a hub takes a whole
run of its edges together: those to single faces that want nothing else before, up to the first edge whose decision could depend on more. Among them the first of each photo joins.

Before such rounds, whole stretches of the scan are done at once. Components of the open edges do not touch each other, so each is scanned by a task
of its own, as long as it has at most STRETCH edges and members. Of a larger component the first STRETCH edges or fewer are scanned likewise: all others come after them.
Only where even these are too many (ties, or groups of very many members) are they left to a round.

Distances are bounded before they are computed: a group keeps one member as its centre, and the largest angle from it to any member. Only
where the triangle inequality leaves a pair of groups open are their members compared, block by block.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.vector import dot, normalised
from lumenfold.operators.graph import components
from lumenfold.sources.storage import dropped, written

BLOCK = 256
#: Angles that differ by less are not told apart by bounds; the members decide.
SLACK = 1e-6
#: Edges of a component that one task scans, and members that it holds, of some 600 bytes each.
STRETCH = 100_000
#: Steps of distance by which the first edges of a component are cut off.
STEPS = 1 << 16


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def _told(open_: DataFrame) -> DataFrame:
    """(root, other, e, first, other_first): each open edge from both of its ends, with the smallest edge of either."""
    sides = open_.select(F.col("a").alias("root"), F.col("b").alias("other"), "e").unionByName(open_.select(F.col("b").alias("root"), F.col("a").alias("other"), "e"))
    first = sides.groupBy("root").agg(F.min("e").alias("first"))
    return sides.join(first, "root").join(first.select(F.col("root").alias("other"), F.col("first").alias("other_first")), "other")


def _runs(told: DataFrame, groups: DataFrame, theta: float) -> tuple[DataFrame, DataFrame]:
    """(root, other, e, turn) of the edges that hubs take together, and (root, other, e) of the smallest edges of the hubs that take none so; turn: angle of the other from the hub's centre."""
    many = told.where("e = other_first").groupBy("root").agg(F.count("*").alias("many"))
    mutual = told.where("e = first and e = other_first").join(many, "root").join(many.select(F.col("root").alias("other"), F.col("many").alias("other_many")), "other")
    hubs = mutual.where((F.col("many") > F.col("other_many")) | ((F.col("many") == F.col("other_many")) & (F.col("root") < F.col("other")))).select("root", F.col("e").alias("mutual"))
    second = told.where("e > first").groupBy(F.col("root").alias("other")).agg(F.min("e").alias("second"))
    own = told.select("root", "other", "e", "other_first").join(hubs, "root").join(second, "other", "left")
    centre = groups.select("root", F.col("vec").alias("centre"), "reach")
    member = groups.select(F.col("root").alias("other"), "vec", "n")
    turn = _angle(F.col("centre"), F.col("vec"))
    laid = own.join(centre, "root").join(member, "other").select("root", "other", "e", "mutual", "other_first", "second", turn.alias("turn"), "reach", "n")
    simple = (F.col("e") == F.col("other_first")) & (F.col("n") == 1) & (F.col("turn") <= F.least(F.lit(theta / 2), F.lit(theta) - F.col("reach")) - SLACK)
    laid = written(laid.withColumn("simple", simple), "hub_edges")
    stop = laid.groupBy("root").agg(F.min(F.least(F.when(~F.col("simple"), F.col("e")), F.when(F.col("e") == F.col("other_first"), F.col("second")))).alias("stop"))
    cut = laid.join(stop, "root").withColumn("taken", F.col("simple") & (F.col("stop").isNull() | (F.col("e") < F.col("stop"))))
    return cut.where("taken").select("root", "other", "e", "turn"), cut.where("e = mutual and not taken").select("root", "other", "e")


def _farthest(pairs: DataFrame, labels: DataFrame, vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, other, far): the largest distance between members of each pair of groups; blocks of either side meet in tasks of their own."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    sized = pairs.join(groups.select("root", F.col("n").alias("n_root")), "root").join(groups.select(F.col("root").alias("other"), F.col("n").alias("n_other")), "other")
    member = labels.join(vectors, "idx").select("idx", F.col("root").alias("of"), "vec")

    def dealt(side: str, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("idx"), blocks(mine)).cast("int")
        far = F.explode(F.sequence(F.lit(0), blocks(theirs) - 1))
        rows = sized.join(member, F.col(side) == F.col("of")).select("root", "other", F.lit(side == "root").alias("left"), "vec", block.alias("_m"), far.alias("_t"))
        return rows.select("root", "other", "left", "vec", *((F.col("_m").alias("p"), F.col("_t").alias("q")) if side == "root" else (F.col("_t").alias("p"), F.col("_m").alias("q"))))

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vec, left = np.array(rows["vec"].tolist(), np.float64), rows["left"].to_numpy(bool)
        far = 1 - vec[left] @ vec[~left].T
        return pd.DataFrame({"root": [key[0]], "other": [key[1]], "far": [float(np.clip(far, 0, 2).max()) if far.size else 0.0]})

    both = dealt("root", "n_root", "n_other").unionByName(dealt("other", "n_other", "n_root"))
    return both.groupBy("root", "other", "p", "q").applyInPandas(product, "root long, other long, far double").groupBy("root", "other").agg(F.max("far").alias("far"))


def _joined(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(root, other, joins, reach) of the runs: the first of each photo joins its hub, unless the hub has the photo."""
    photo = runs.join(labels.select(F.col("root").alias("other"), "photo_id"), "other")  # single faces
    first = photo.groupBy("root", "photo_id").agg(F.min("e").alias("least"))
    held = labels.select("root", "photo_id", F.lit(True).alias("held")).distinct()
    seen = photo.join(first, ["root", "photo_id"]).join(held, ["root", "photo_id"], "left")
    return seen.select("root", "other", (F.col("held").isNull() & (F.col("e") == F.col("least"))).alias("joins"), F.col("turn").alias("reach"))


def _paired(pairs: DataFrame, labels: DataFrame, vectors: DataFrame, groups: DataFrame, complete: float, theta: float) -> DataFrame:
    """(root, other, joins, reach) of single edges between groups of any size."""
    photos = labels.select("root", "photo_id").distinct()
    left = pairs.join(photos, "root").select("root", "other", "photo_id")
    shared = left.join(photos.select(F.col("root").alias("other"), "photo_id"), ["other", "photo_id"], "left_semi").select("root", "other").distinct().withColumn("shared", F.lit(True))
    side = groups.select(F.col("root").alias("other"), F.col("vec").alias("o_vec"), F.col("reach").alias("o_reach"))
    met = pairs.join(shared, ["root", "other"], "left").join(groups.select("root", "vec", "reach"), "root").join(side, "other")
    turn = _angle(F.col("vec"), F.col("o_vec"))
    bound = turn + F.col("reach") + F.col("o_reach")
    sure = F.when(F.col("shared"), False).when(F.lit(complete >= 2) | (bound <= theta - SLACK), True).when(turn > theta + SLACK, False)
    judged = met.select("root", "other", sure.alias("joins"), F.greatest(F.col("reach"), turn + F.col("o_reach")).alias("reach"))
    far = _farthest(judged.where("joins is null").select("root", "other"), labels, vectors, groups)
    return judged.join(far, ["root", "other"], "left").select("root", "other", F.coalesce("joins", F.col("far") <= complete, F.lit(False)).alias("joins"), "reach")


def _scan(members: pd.DataFrame, edges: pd.DataFrame, complete: float) -> pd.DataFrame:
    """(root, to) of the groups that join another after the scan of the edges (a, b, dist, l, r). members: root, photo_id, vec."""
    vec = np.array(members["vec"].tolist(), np.float64)
    held = {k: v.tolist() for k, v in members.groupby("root").indices.items()}
    photo = members["photo_id"].to_numpy()
    photos, to = {k: set(photo[v]) for k, v in held.items()}, {}

    def root(x: int) -> int:
        while x in to:
            up = to[x]
            to[x] = to.get(up, up)
            x = up
        return x

    for a, b in edges.sort_values(["dist", "l", "r"])[["a", "b"]].itertuples(index=False):
        x, y = root(a), root(b)
        if x == y or not photos[x].isdisjoint(photos[y]):
            continue
        if len(held[x]) < len(held[y]):
            x, y = y, x
        left, right = vec[held[x]], vec[held[y]]
        if any((np.clip(1 - left[i : i + BLOCK] @ right.T, 0, 2) > complete).any() for i in range(0, len(left), BLOCK)):
            continue
        to[y] = x
        held[x] += held.pop(y)
        photos[x] |= photos.pop(y)
    return pd.DataFrame({"root": list(to), "to": [root(x) for x in to]}, dtype="int64")


def _stretches(open_: DataFrame, labels: DataFrame, stretch: int) -> DataFrame:
    """(unit, a, b, e) of the edges that are next in their component and few enough for a task, unit by unit."""

    def units(edges: DataFrame) -> DataFrame:
        named = components(edges.select("a", "b"))
        part = edges.select("a", "b", "e").join(named.select(F.col("node").alias("a"), F.col("label").alias("unit")), "a")
        members = named.join(labels, F.col("node") == F.col("root")).groupBy(F.col("label").alias("unit")).agg(F.count("*").alias("_members"))
        size = part.groupBy("unit").agg(F.count("*").alias("_n")).join(members, "unit")
        return written(part.join(size, "unit"), "units")

    one, columns = units(open_), ["unit", "a", "b", "e"]
    fits = (F.col("_n") <= stretch) & (F.col("_members") <= stretch)
    if not one.where(~fits).limit(1).count():
        return one.select(*columns)
    big = one.where(~fits).withColumn("_step", F.floor(F.col("e.dist") * (STEPS / 2)))
    upto = F.sum("_k").over(W.partitionBy("unit").orderBy("_step"))
    steps = big.groupBy("unit", "_step").agg(F.count("*").alias("_k")).withColumn("_upto", upto).where(F.col("_upto") <= stretch)
    first = written(big.join(steps.select("unit", "_step"), ["unit", "_step"], "left_semi").select("a", "b", "e"), "first")
    return one.where(fits).select(*columns).unionByName(units(first).where(F.col("_members") <= stretch).select(*columns))


def _scanned(spans: DataFrame, labels: DataFrame, vectors: DataFrame, complete: float) -> DataFrame:
    """(root, to) of the groups that join another in the stretches (unit, a, b, e)."""
    ends = spans.select("unit", F.explode(F.array("a", "b")).alias("root")).distinct()
    members = ends.join(labels, "root").join(vectors, "idx").select("unit", "root", "photo_id", "vec")
    edges = spans.select(F.col("unit").alias("of"), "a", "b", "e.*")
    run = lambda members, edges: _scan(members, edges, complete)
    return members.groupBy("unit").cogroup(edges.groupBy("of")).applyInPandas(run, "root long, to long")


def _reaches(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """(root, vec, reach, n) of all groups."""
    centre = vectors.select(F.col("idx").alias("root"), F.col("vec").alias("centre"))
    met = labels.select("idx", "root").join(vectors, "idx").join(centre, "root")
    turn = F.when(F.col("idx") == F.col("root"), 0.0).otherwise(_angle(F.col("centre"), F.col("vec")))
    far = met.groupBy("root").agg(F.max(turn).alias("reach"), F.count("*").alias("n"))
    return far.join(centre, "root").select("root", F.col("centre").alias("vec"), "reach", "n")


def _renamed(open_: DataFrame, moves: DataFrame) -> DataFrame:
    """The open edges between the groups that are left, the smallest of each two groups."""
    name = lambda c: moves.select(F.col("root").alias(c), F.col("to").alias(f"{c}_to"))
    rest = open_.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"), "e")
    return rest.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))


def constrained_groups(anchors: DataFrame, edges: DataFrame, complete: float, stretch: int = STRETCH) -> DataFrame:
    """(idx, root) of each anchor after the scan; root is the smallest member.

    anchors: idx, vec, photo_id, one row an idx; edges: l, r, dist. A null photo is a photo of its own. Anchors without an edge are their own root; no anchors give no rows.
    """
    spark, theta = anchors.sparkSession, math.acos(max(-1.0, 1 - complete))
    ends = edges.select(F.explode(F.array("l", "r")).alias("idx")).distinct()
    vectors = written(anchors.join(ends, "idx", "left_semi").select("idx", normalised(F.col("vec")).alias("vec")), "vectors")
    own = F.coalesce(F.concat(F.lit("p"), F.col("photo_id").cast("string")), F.concat(F.lit("i"), F.col("idx").cast("string")))
    labels = written(anchors.join(ends, "idx", "left_semi").select("idx", F.col("idx").alias("root"), own.alias("photo_id")), "labels")
    open_ = written(edges.where("l <> r").groupBy(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).agg(F.min(F.struct("dist", "l", "r")).alias("e")), "open")
    moved = lambda c: F.coalesce("to", c)
    while open_.limit(1).count():
        spans = written(_stretches(open_, labels, stretch), "spans") if stretch else open_.limit(0)
        if spans.limit(1).count():
            moves, gone = written(_scanned(spans, labels, vectors, complete), "moves"), spans.select("a", "b")
        else:
            groups = written(_reaches(labels, vectors), "groups")
            runs, pairs = _runs(_told(open_), groups, theta)
            done = written(_joined(runs, labels).unionByName(_paired(pairs, labels, vectors, groups, complete, theta)), "decided")
            moves = done.where("joins").select(F.col("other").alias("root"), F.col("root").alias("to"))
            gone = done.where("not joins").select(F.least("root", "other").alias("a"), F.greatest("root", "other").alias("b"))
        fresh = written(labels.join(moves, "root", "left").select("idx", moved("root").alias("root"), "photo_id"), "labels")
        after = written(_renamed(open_.join(gone, ["a", "b"], "left_anti"), moves), "open")
        for old in (labels, open_):
            dropped(spark, old)
        labels, open_ = fresh, after
    least = labels.groupBy("root").agg(F.min("idx").alias("least"))
    merged = labels.join(least, "root").select("idx", F.col("least").alias("root"))
    alone = anchors.join(ends, "idx", "left_anti").select("idx", F.col("idx").alias("root"))
    return reduce(DataFrame.unionByName, [merged, alone])
