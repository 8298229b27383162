"""Similarity joins in blocks, bounded neighbour edges, groups and their choices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions.vector import normalised

BLOCK = 256
#: Rows of either side that meet in one task, and of those the rows whose distances are in memory at once.
PART, TILE = 2048, 256


def near_pairs(df: DataFrame, scope: str, most: float, block: int = BLOCK, keep: int | None = None) -> DataFrame:
    """(scope, src, dst, dist) of all ordered pairs of rows of a scope whose cosine distance is `most` or less.

    df: scope, idx, vec. Rows are dealt to blocks by a hash, and each pair of blocks is one task's product
    of two small matrices, so a scope of any size is spread, and only near pairs leave a task. keep:
    the nearest so many of each source in a pair of blocks, which is all that a k-nearest result can need.
    """
    count = df.groupBy(scope).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = df.select(scope, "idx", "vec").join(count, scope).withColumn("_b", F.pmod(F.xxhash64("idx"), F.col("_n")).cast("int"))
    other = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pairs = other.select(scope, "idx", "vec", "_b", F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"))
    kind = dict(df.dtypes)[scope]

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        vec = np.array(rows["vec"].tolist(), np.float64)
        vec /= np.linalg.norm(vec, axis=1, keepdims=True)
        ids, side = rows["idx"].to_numpy(), rows["_b"].to_numpy()
        dist = np.clip(1 - vec @ vec.T, 0, 2)
        ok = dist <= most
        np.fill_diagonal(ok, False)
        if key[1] != key[2]:
            ok &= side[:, None] != side[None, :]
        if keep and keep < len(ids):
            order = np.argsort(np.where(ok, dist, np.inf), axis=1, kind="stable")[:, :keep]
            near = np.zeros_like(ok)
            np.put_along_axis(near, order, True, axis=1)
            ok &= near
        a, b = np.nonzero(ok)
        return pd.DataFrame({scope: key[0], "src": ids[a], "dst": ids[b], "dist": dist[a, b]})

    return pairs.groupBy(scope, "_p", "_q").applyInPandas(product, f"{scope} {kind}, src long, dst long, dist double")


def bounded_edges(df: DataFrame, scope: str, merge: float, most: int = 64, block: int = BLOCK) -> DataFrame:
    """(scope, l, r, dist): edges l < r between each row and its nearest `most` others within the merge distance, ties to the smaller id."""
    near = near_pairs(df, scope, merge, block, most)
    rank = F.row_number().over(W.partitionBy(scope, "src").orderBy("dist", "dst"))
    kept = near.withColumn("_r", rank).where(F.col("_r") <= most)
    return kept.groupBy(scope, F.least("src", "dst").alias("l"), F.greatest("src", "dst").alias("r")).agg(F.min("dist").alias("dist"))


def _distances(left: list, right: list) -> np.ndarray:
    """Cosine distances of all pairs, summed component by component, so that equal vectors have equal distances wherever they stand, as BLAS does not promise; 2 where a vector is null, of another length or not a number."""
    out = np.full((len(left), len(right)), 2.0)
    sizes = [np.array([-1 if v is None else len(v) for v in side], np.int64) for side in (left, right)]
    for size in np.intersect1d(*sizes):
        if size < 0:
            continue
        at = [np.flatnonzero(s == size) for s in sizes]
        a, b = (np.array([side[i] for i in rows], np.float64).reshape(len(rows), size).T.copy() for side, rows in zip((left, right), at, strict=True))
        total, part = np.zeros((2, len(at[0]), len(at[1])))
        lengths = [np.zeros(len(rows)) for rows in at]
        for x, y in zip(a, b, strict=True):
            total += np.multiply(x[:, None], y[None, :], out=part)
            lengths[0] += x * x
            lengths[1] += y * y
        if any((x == 0).any() for x in lengths):
            raise ValueError("vector without direction")
        with np.errstate(invalid="ignore"):
            found = np.clip(1 - total / (np.sqrt(lengths[0])[:, None] * np.sqrt(lengths[1])[None, :]), 0, 2)
        out[np.ix_(*at)] = np.where(np.isnan(found), 2.0, found)
    return out


def group_distances(rows: DataFrame, members: DataFrame, taken: DataFrame, scope: str = "gallery", most: int | None = None, part: int = PART) -> DataFrame:
    """(scope, idx, root, nearest, farthest): distances of each row to the members of each group of its scope that has not its photo.

    rows: scope, idx, photo_id, vec; members: scope, root, vec; taken: scope, root, photo_id. Both sides are dealt to parts, and every two parts of a scope meet
    in one task, so a vector is sent once for each part of the other side, never once for each pair. A group lies in one part unless it is larger, and so do a photo's rows.
    most: only the nearest so many groups of each row in a pair of parts leave the task. These hold the row's nearest so many of all, for where a group is nearest, only nearer groups come before it; farthest is then not whole.
    """
    kind = dict(rows.dtypes) | {"root": dict(members.dtypes)["root"]}
    photo = F.col("photo_id").cast("string").alias("photo")
    rows = rows.where(F.col(scope).isNotNull()).select(scope, "idx", photo, "vec")
    members = members.where(F.col(scope).isNotNull()).select(scope, "root", "vec")
    pieces = F.ceil(F.count("*") / part).cast("int")
    of_root = members.groupBy(scope, "root").agg(pieces.alias("_pieces"))
    of_photo = rows.groupBy(F.col(scope).alias("_of"), F.col("photo").alias("_photo")).agg(pieces.alias("_shares"))
    parts = members.groupBy(scope).agg(pieces.alias("_nq")).join(rows.groupBy(scope).agg(pieces.alias("_np")), scope)
    p, q = F.pmod(F.xxhash64("photo", "_share"), F.col("_np").cast("long")), F.pmod(F.xxhash64("root", "_piece"), F.col("_nq").cast("long"))
    none = {"idx": F.lit(0).cast(kind["idx"]), "photo": F.lit(None).cast("string"), "root": F.lit(0).cast(kind["root"]), "vec": F.lit(None).cast("array<double>")}
    columns = lambda side, *have: [scope, F.lit(side).alias("side"), *(F.col(c) if c in have else none[c].alias(c) for c in none)]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    same = (F.col(scope) == F.col("_of")) & F.col("photo").eqNullSafe(F.col("_photo"))
    shared = rows.join(of_photo, same).join(parts, scope).withColumn("_share", F.pmod(F.xxhash64("idx"), F.col("_shares").cast("long")))
    left = shared.select(*columns(0, "idx", "photo", "vec"), p.alias("p"), upto("_nq").alias("q"))
    pieced = members.join(of_root, [scope, "root"]).join(parts, scope).withColumn("_piece", F.pmod(F.xxhash64("vec"), F.col("_pieces").cast("long")))
    right = pieced.select(*columns(1, "root", "vec"), upto("_np").alias("p"), q.alias("q"))
    known = taken.select(scope, "root", photo).distinct().join(of_root, [scope, "root"]).join(of_photo, (F.col(scope) == F.col("_of")) & (F.col("photo") == F.col("_photo"))).join(parts, scope)
    spread = known.withColumn("_piece", upto("_pieces")).withColumn("_share", upto("_shares")).select(*columns(2, "root", "photo"), p.alias("p"), q.alias("q"))

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one, many, bar = rows[rows["side"] == 0], rows[rows["side"] == 1].sort_values("root", kind="stable"), rows[rows["side"] == 2]
        photo, photos = pd.factorize(one["photo"])
        roots, first = np.unique(many["root"].to_numpy(), return_index=True)
        out: list[tuple[np.ndarray, ...]] = []
        if len(one) and len(many):
            barred = np.zeros((len(photos) + 1, len(roots)), bool)  # the last row is that of null photos
            x, y = pd.Index(photos).get_indexer(bar["photo"]), pd.Index(roots).get_indexer(bar["root"])
            barred[x[(x >= 0) & (y >= 0)], y[(x >= 0) & (y >= 0)]] = True
            ids, vec, other = one["idx"].to_numpy(), one["vec"].tolist(), many["vec"].tolist()
            for at in range(0, len(ids), TILE):
                dist = np.concatenate([_distances(vec[at : at + TILE], other[k : k + TILE]) for k in range(0, len(other), TILE)], axis=1)
                near, far = np.minimum.reduceat(dist, first, axis=1), np.maximum.reduceat(dist, first, axis=1)
                near[barred[photo[at : at + TILE]]] = np.inf
                if most is None:
                    a, b = np.nonzero(near < np.inf)
                    out.append((ids[at + a], roots[b], near[a, b], far[a, b]))
                for _ in range(min(most or 0, len(roots))):  # ties to the smaller root, which comes first
                    a, b = np.arange(len(near)), near.argmin(axis=1)
                    fine = near[a, b] < np.inf
                    out.append((ids[at + a[fine]], roots[b[fine]], near[a, b][fine], far[a, b][fine]))
                    near[a, b] = np.inf
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pd.DataFrame({scope: key[0], "idx": columns[0], "root": columns[1], "nearest": columns[2], "farthest": columns[3]})

    met = left.unionByName(right).unionByName(spread).groupBy(scope, "p", "q").applyInPandas(meet, f"{scope} {kind[scope]}, idx {kind['idx']}, root {kind['root']}, nearest double, farthest double")
    return met.groupBy(scope, "idx", "root").agg(F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))


def best_two(df: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """df with `rank` by (score, name) and `second`, the score that comes after a row's own in its group."""
    order = W.partitionBy(*by).orderBy(score, name)
    return df.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead(score).over(order))


def attached(scored: DataFrame, attach: float, margin: float) -> DataFrame:
    """Weak rows that join a group. scored: idx, photo_id, root, score for every group that may take the row.

    A row needs its best score within `attach` and the next one `margin` behind; of the rows of a photo that want the same group, the best by (score, margin, id) gets it.
    """
    top = best_two(scored, ["idx"], "score", "root").where("rank = 1").withColumn("gap", F.coalesce(F.col("second") - F.col("score"), F.lit(float("inf"))))
    fine = top.where((F.col("score") <= attach) & (F.col("gap") >= margin))
    claim = F.row_number().over(W.partitionBy("photo_id", "root").orderBy("score", F.desc("gap"), "idx"))
    return fine.withColumn("_claim", claim).where("_claim = 1").select("idx", "root", "score")


def stable_pairs(new: DataFrame, old: DataFrame, least: float = 0.5) -> DataFrame:
    """(new_id, old_id, overlap, jaccard): groups that share more than `least` of both; such pairs are one to one.

    new: new_id, member; old: old_id, member.
    """
    size = lambda d, c: d.groupBy(c).agg(F.count("*").alias(f"n_{c}"))
    both = new.join(old, "member").groupBy("new_id", "old_id").agg(F.count("*").alias("overlap"))
    rows = both.join(size(new, "new_id"), "new_id").join(size(old, "old_id"), "old_id")
    fine = (F.col("overlap") / F.col("n_new_id") > least) & (F.col("overlap") / F.col("n_old_id") > least)
    return rows.where(fine).select("new_id", "old_id", "overlap", (F.col("overlap") / (F.col("n_new_id") + F.col("n_old_id") - F.col("overlap"))).alias("jaccard"))


def centroid(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Unit mean vector of each group: a mean for each component, summed on the map side, then put in order."""
    parts = df.select(*by, F.posexplode(vec).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    whole = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(*by, normalised(F.col("mean")).alias("centroid"))
