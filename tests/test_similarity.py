"""Clustering, choices, identities, and the functions under them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.codec import from_bytes, to_bytes
from lumenfold.functions.geometry import iou, suppressed, tiles
from lumenfold.functions.vector import normalised
from lumenfold.operators.jumps import anchored_windows
from lumenfold.operators.graph import components
from lumenfold.operators.scans import paced
from lumenfold.operators.similarity import bounded_edges, group_distances, stable_pairs
from lumenfold.plans.similarity import assigned, chosen, cluster_labels, decided, lasting, prototype_scores, prototypes, weak_scores

V = lambda d: [1 - d, math.sqrt(1 - (1 - d) ** 2)]
DEG = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
FACES = "idx long, vec array<double>, photo_id string, is_anchor boolean, manual_group string, gallery int"


def labels(spark, rows, merge=0.45, complete=0.52, attach=0.38, margin=0.05, most=64):
    df = spark.createDataFrame([(i, v, p, a, m, 0) for i, (v, p, a, m) in enumerate(rows)], FACES)
    return [r.root for r in cluster_labels(df, merge, complete, attach, margin, most).orderBy("idx").collect()]


@pytest.mark.parametrize(
    ("rows", "options", "check"),
    [
        ([([1.0, 0.0], "a", True, None), (V(0.02), "a", True, None), (V(0.03), "b", True, None)], {}, lambda r: r[0] != r[1] and r[2] in r[:2]),
        ([([1.0, 0.0], "a", True, None), (V(0.44), "b", True, None)], {}, lambda r: r[0] == r[1]),
        ([([1.0, 0.0], "a", True, None), (V(0.46), "b", True, None)], {}, lambda r: r[0] != r[1]),
        ([([1.0, 0.0], "a", True, None), (V(0.37), "b", False, None), (V(0.40), "c", False, None)], {}, lambda r: r[0] == r[1] != r[2]),
        ([([1.0, 0.0], "s", True, None), (V(0.10), "s", False, None)], {}, lambda r: r[0] != r[1]),
        ([(DEG(0), "a", True, None), (DEG(50), "b", True, None), (DEG(80), "c", True, None)], {"most": 2}, lambda r: r[0] != r[1] == r[2]),
        ([([1.0, 0.0], "a", True, None), (V(0.30), "s", False, None), (V(0.10), "s", False, None)], {}, lambda r: r[0] == r[2] != r[1]),
        ([([1.0, 0.0], "a", True, "g"), ([-1.0, 0.0], "b", True, "g")], {"merge": 0.1}, lambda r: r[0] == r[1]),
    ],
)
def test_cluster_cases(spark, rows, options, check):
    assert check(labels(spark, rows, **options))


def test_dense_graph_is_bounded(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(120)], "idx long, vec array<double>, gallery int")
    edges = bounded_edges(df, "gallery", 0.45, 4, 17)
    assert 119 <= edges.count() <= 480


def whole(vec, photo, anchor, merge, complete, attach, margin):
    """The contract over all rows at once."""
    n = len(vec)
    d = np.clip(1 - vec @ vec.T, 0, 2)
    root, member, photos = list(range(n)), {i: [i] for i in range(n)}, {i: {photo[i]} for i in range(n)}
    for _, a, b in sorted((d[a, b], a, b) for a in range(n) for b in range(a + 1, n) if anchor[a] and anchor[b] and d[a, b] <= merge):
        x, y = sorted((root[a], root[b]))
        if x == y or photos[x] & photos[y] or d[np.ix_(member[x], member[y])].max() > complete:
            continue
        for i in member[y]:
            root[i] = x
        member[x] += member.pop(y)
        photos[x] |= photos.pop(y)
    found = []
    for i in (i for i in range(n) if not anchor[i]):
        score = sorted((min(d[i, j] for j in m), r) for r, m in member.items() if anchor[r] and photo[i] not in photos[r])
        gap = score[1][0] - score[0][0] if len(score) > 1 else math.inf
        if score and score[0][0] <= attach and gap >= margin:
            found.append((photo[i], score[0][1], score[0][0], -gap, i))
    taken = set()
    for p, r, _, _, i in sorted(found, key=lambda x: x[2:]):
        if (p, r) not in taken:
            taken.add((p, r))
            root[i] = r
    return root


def test_clusters_match_brute_force(spark):
    rnd = np.random.default_rng(5)
    vec = rnd.normal(size=(60, 4))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    photo, anchor = [str(i % 17) for i in range(60)], [i % 3 > 0 for i in range(60)]
    rows = [(v.tolist(), p, a, None) for v, p, a in zip(vec, photo, anchor, strict=True)]
    assert labels(spark, rows, 0.3, 0.45, 0.3, 0.02) == whole(vec, photo, anchor, 0.3, 0.45, 0.3, 0.02)


@pytest.mark.parametrize("part", [4, 2048])
def test_group_distances_by_parts(spark, part):
    """Groups and photos of more rows than a part, one that spans all parts, null photos and scopes, copies in two groups: as brute force."""
    rnd = np.random.default_rng(8)
    vec = rnd.normal(size=(90, 5)).round(1).tolist()
    vec[41], vec[42] = vec[40], vec[40]
    rows = [(i, i % 2 if i else None, None if i % 7 == 3 else str(i % 7), vec[i]) for i in range(40)]
    held = [(1 if i < 60 else i % 9, i % 2, str(i % 5), vec[i]) for i in range(40, 90)]
    one = spark.createDataFrame(rows, "idx long, gallery int, photo_id string, vec array<double>")
    many = spark.createDataFrame(held, "root long, gallery int, photo_id string, vec array<double>")
    want = {}
    for idx, gallery, photo, v in rows:
        barred = {h[0] for h in held if h[1] == gallery and h[2] == photo}
        for root, _, _, w in (h for h in held if h[1] == gallery and h[0] not in barred):
            want.setdefault((idx, root), []).append(1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    got = {(r.idx, r.root): (r.nearest, r.farthest) for r in group_distances(one, many, many, part=part).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx((min(d), max(d))) for k, d in want.items())
    two = {}
    for r in group_distances(one, many, many, most=2, part=part).collect():
        two.setdefault(r.idx, []).append((r.nearest, r.root))
    assert {i: sorted(x)[:2] for i, x in two.items()} == {i: sorted((got[k][0], k[1]) for k in got if k[0] == i)[:2] for i in two}
    assert two.keys() == {k[0] for k in got}


def test_weak_rows_keep_their_nearest_groups_alone(spark):
    """A weak row leaves a task with two groups, not with one for each of its gallery."""
    anchors = spark.createDataFrame([(0, r, f"a{r}", DEG(5 * r)) for r in range(12)], "gallery int, root long, photo_id string, vec array<double>")
    weak = spark.createDataFrame([(0, 50 + i, f"a{i}", DEG(5 * i + 1)) for i in range(6)], "gallery int, idx long, photo_id string, vec array<double>")
    got = sorted((r.idx, r.root) for r in weak_scores(weak, anchors).collect())
    assert got == sorted((50 + i, r) for i in range(6) for r in ([1, 2] if i == 0 else [i - 1, i + 1]))


def test_selfie_decision(spark):
    rows = [(1, "a", 0.30, 2), (1, "b", 0.34, 2), (2, "a", 0.44, 1), (3, "a", 0.44, 2)]
    df = spark.createDataFrame(rows, "idx int, cluster_id string, best double, support int")
    got = {r.idx: (r.cluster_id, r.distance) for r in decided(df, 0.50, 0.38, 0.08).collect()}
    assert got == {1: (None, 0.30), 2: (None, 0.44), 3: ("a", 0.44)}


def test_incremental_choice(spark):
    rows = [(1, True, "p", True, 0.36, 0.83), (2, False, "f", True, 0.30, 0.30), (2, False, "s", True, 0.33, 0.33), (3, True, "w", False, 0.37, 0.37), (4, True, "w", False, 0.40, 0.40)]
    df = spark.createDataFrame(rows, "idx int, is_anchor boolean, cluster_id string, has_anchor boolean, nearest double, farthest double")
    got = {r.idx: r.cluster_id for r in chosen(df, 0.45, 0.52, 0.38, 0.05).collect()}
    assert got == {1: None, 2: None, 3: "w", 4: None}


def test_incremental_assign(spark):
    """Against a fold in the order of ids: groups with the photo are skipped, weak-only groups count, a photo's second face is refused."""
    rnd = random.Random(3)
    held = [(i, DEG(60 * (i % 6) + rnd.uniform(-8, 8)), rnd.randrange(25), i % 6 != 5 and i % 3 != 1, 0, i % 6) for i in range(36)]
    fresh = [(100 + i, DEG(60 * (i % 6) + rnd.uniform(-12, 12)), rnd.randrange(25), i % 4 != 0, 0, None) for i in range(60)]
    kind = "idx long, vec array<double>, photo_id long, is_anchor boolean, gallery int, cluster_id long"
    got = {r.idx: r.cluster_id for r in assigned(spark.createDataFrame(held, kind), spark.createDataFrame(fresh, kind).drop("cluster_id"), 0.3, 0.4, 0.3, 0.05).collect()}
    want, photos = {}, {c: {h[2] for h in held if h[5] == c} for c in range(6)}
    before = {c: set(p) for c, p in photos.items()}
    for idx, vec, photo, anchor, _, _ in fresh:
        scored = {}
        for c in range(6):
            strong = [h[1] for h in held if h[5] == c and h[3]]
            if photo in before[c] or not (anchor or strong):
                continue
            dist = [1 - float(np.dot(vec, p)) for p in strong or [h[1] for h in held if h[5] == c]]
            near, far = min(dist), max(dist)
            ok = strong and near <= 0.3 if not anchor else (near <= 0.3 and far <= 0.4 if strong else far <= 0.3)
            scored[c] = (near, bool(ok))
        best = min(((d, c) for c, (d, ok) in scored.items() if ok), default=None)
        want[idx] = best[1] if best and all(d - best[0] >= 0.05 for c, (d, _) in scored.items() if c != best[1]) else None
        if want[idx] is not None and photo in photos[want[idx]]:
            want[idx] = None
        elif want[idx] is not None:
            photos[want[idx]].add(photo)
    assert got == want
    assert {0, 5, None} <= set(want.values())


@pytest.mark.parametrize(
    ("new", "old", "want"),
    [
        ([{1, 2, 4}, {3}], {"A": {1, 2}, "B": {3}}, {(0, "A"), (1, "B")}),
        ([{1, 2, 3, 4, 5}], {"A": {1}}, set()),
        ([{1, 2, 3, 4}], {"A": {1, 2}}, set()),
        ([{1, 2}], {"A": {1, 2, 3, 4, 5}}, set()),
        ([{1, 2, 3}, {4, 5, 6}], {"B": {4, 5, 6}, "A": {1, 2, 3}}, {(0, "A"), (1, "B")}),
    ],
)
def test_stable_identity(spark, new, old, want):
    n = spark.createDataFrame([(i, m) for i, s in enumerate(new) for m in s], "new_id int, member int")
    o = spark.createDataFrame([(k, m) for k, s in old.items() for m in s], "old_id string, member int")
    assert {(r.new_id, r.old_id) for r in stable_pairs(n, o).collect()} == want


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    top = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == top


def test_geometry(spark):
    rows = [(0.80, 0, 0.0, 0.0, 100.0, 100.0), (0.95, 1, 4.0, 4.0, 104.0, 104.0), (0.70, 2, 200.0, 200.0, 240.0, 240.0)]
    df = spark.createDataFrame([(rows,)], "b array<struct<score:double,idx:int,x1:double,y1:double,x2:double,y2:double>>")
    kept = df.select(F.transform(suppressed(F.col("b"), 0.4), lambda x: x["idx"]).alias("k"), iou(F.col("b")[0], F.col("b")[1]).alias("iou"), F.size(tiles(F.lit(1700), F.lit(1700))).alias("n"), F.size(tiles(F.lit(900), F.lit(900))).alias("m")).first()
    assert kept.k == [1, 2]
    assert kept.iou > 0.4
    assert (kept.n, kept.m) == (5, 1)


def test_folds(spark):
    hits = spark.createDataFrame([("a", s * 1_000_000, s) for s in (0, 1, 2, 3600, 3601, 7300)], "k string, t long, i long")
    assert [r.allowed for r in anchored_windows(hits, ["k"], "t", "i", 3600, 2).orderBy("i").collect()] == [True, True, False, True, True, True]
    odd = spark.createDataFrame([(None, 5, 1), ("b", None, 2), ("b", 0, 3), (None, 5, 4), ("b", 0, 3)], "k string, t long, i long")
    found = sorted((r.k or "", r.i, r.allowed) for r in anchored_windows(odd, ["k"], "t", "i", 3600, 1).collect())
    assert found == [("", 1, True), ("", 4, False), ("b", 2, True), ("b", 3, False), ("b", 3, True)]  # a hit without a time opens no window
    assert anchored_windows(odd.limit(0), ["k"], "t", "i", 3600, 1).count() == 0
    long = spark.range(30_000).select(F.lit("a").alias("k"), (F.col("id") * 1_000_000).alias("t"), F.col("id").alias("i"))  # several Arrow batches of one key
    assert anchored_windows(long, ["k"], "t", "i", 100, 3).where("allowed").count() == 900
    arrivals = spark.createDataFrame([("a", t, i) for i, t in enumerate((0, 100, 200, 20_000, 20_001))], "k string, t long, i long")
    assert [r.slot for r in paced(arrivals, ["k"], "t", "i", 3000).orderBy("i").collect()] == [0, 3000, 6000, 20_000, 23_000]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), (None,)], "v array<double>")
    assert [r.b for r in df.select(from_bytes(to_bytes("v"), 2).alias("b")).collect()] == [[3.0, 4.0], None]
    assert df.where("v is not null").select(normalised(F.col("v")).alias("u")).first().u == [0.6, 0.8]
    with pytest.raises(Exception, match="direction"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(normalised(F.col("v"))).collect()


def test_groups_without_anchors_are_matched_by_their_centroid(spark):
    faces = [(1, [1.0, 0.0], 0.9, True, 0, 1), (2, [0.0, 1.0], 0.2, False, 0, 2), (3, [0.0, 3.0], 0.1, False, 0, 2), (4, [-1.0, 0.0], 0.1, False, 0, 3)]
    rows = spark.createDataFrame(faces, "idx long, vec array<double>, quality double, is_anchor boolean, gallery int, cluster_id long")
    proto = {r.cluster_id: (r.p_idx, r.p_vec) for r in prototypes(rows).collect()}
    assert proto == {1: (1, [1.0, 0.0]), 2: (None, [0.0, 1.0]), 3: (None, [-1.0, 0.0])}
    selfie = spark.createDataFrame([(9, [0.1, 1.0], 0)], "idx long, vec array<double>, gallery int")
    found = decided(prototype_scores(selfie, prototypes(rows), 0.5), 0.5, 0.38, 0.08).first()
    assert (found.idx, found.cluster_id) == (9, 2) and found.distance < 0.01


def test_lasting_ids(spark):
    named = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (0, 1, 3), (0, 7, 7), (0, 8, 8), (0, 8, 9)], "gallery int, root long, idx long")
    old = spark.createDataFrame([("A", 1), ("A", 2), ("B", 7), ("B", 20), ("C", 8), ("C", 9), ("C", 21)], "old_id string, member long")
    got = {r.root: r.cluster for r in lasting(named, old).collect()}
    assert got[1] == "A" and got[8] == "C" and len(got[7]) == 12
