"""Merging in rounds against the scan."""

import random

import numpy as np
import pytest

from lumenfold.operators import merging
from lumenfold.operators.merging import constrained_groups


def scanned(vec, photo, edges, complete):
    """The contract, edge by edge."""
    n = len(vec)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    d = np.clip(1 - unit @ unit.T, 0, 2)
    root, member = list(range(n)), {i: [i] for i in range(n)}
    photos = {i: {photo[i]} if photo[i] is not None else {("own", i)} for i in range(n)}
    for _, a, b in sorted((x, a, b) for a, b, x in edges):
        x, y = sorted((root[a], root[b]))
        if x == y or photos[x] & photos[y] or d[np.ix_(member[x], member[y])].max() > complete:
            continue
        for i in member[y]:
            root[i] = x
        member[x] += member.pop(y)
        photos[x] |= photos.pop(y)
    return root


def graphs(many, seed):
    """Random graphs one beside the other in one table, so that a round decides for all of them: (ids, vectors, photos, edges, roots)."""
    rnd, draw = random.Random(seed), np.random.default_rng(seed)
    rows, edges, want, base = [], [], [], 0
    for g in range(many):
        n = rnd.randrange(2, 6)
        centre = draw.normal(size=(rnd.randrange(1, 4), 3))
        vec = centre[draw.integers(0, len(centre), n)] + draw.normal(size=(n, 3)) * rnd.choice([0.0, 0.05, 0.3, 1.0])
        photo = [rnd.choice([None, *range(rnd.choice([2, 4, 30]))]) for _ in range(n)]
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < rnd.choice([0.2, 0.6, 1.0])]
        far = lambda a, b: float(1 - vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]))  # noqa: B023, E731
        own = [(a, b, rnd.choice([0.0, 0.1, round(far(a, b), 1), far(a, b)])) for a, b in pairs]
        want += [base + r for r in scanned(vec, photo, own, 0.3)]
        rows += [(base + i, vec[i].tolist(), None if photo[i] is None else f"{g}-{photo[i]}") for i in range(n)]
        edges += [(base + a, base + b, x) for a, b, x in own]
        base += n
    return rows, edges, want


def grouped(spark, rows, edges, complete):
    anchors = spark.createDataFrame(rows, "idx long, vec array<double>, photo_id string").repartition(3)
    found = constrained_groups(anchors, spark.createDataFrame(edges, "l long, r long, dist double"), complete).collect()
    assert len(found) == len(rows)
    return [r.root for r in sorted(found, key=lambda r: r.idx)]


def test_random_graphs(spark):
    rows, edges, want = graphs(40, 1)
    assert grouped(spark, rows, edges, 0.3) == want


def test_one_large_component(spark):
    """Copies and near copies of one face in a third of all rows: hubs take whole runs, so rounds stay few."""
    rnd = np.random.default_rng(3)
    n, photo = 24, [f"p{i % 10}" for i in range(24)]
    vec = np.tile([1.0, 0, 0, 0], (n, 1))
    vec[12:] += rnd.normal(size=(12, 4)) * 0.02
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    d = np.clip(1 - unit @ unit.T, 0, 2)
    near = np.argsort(d + np.eye(n) * 9, axis=1, kind="stable")[:, :8]
    edges = sorted({(min(a, b), max(a, b)) for a in range(n) for b in near[a].tolist()})
    edges = [(a, b, float(d[a, b])) for a, b in edges]
    rows = [(i, vec[i].tolist(), photo[i]) for i in range(n)]
    assert grouped(spark, rows, edges, 0.5) == scanned(vec, photo, edges, 0.5)


@pytest.mark.parametrize("stretch", [100_000, 12])
def test_components_are_scanned_without_rounds(spark, monkeypatch, stretch):
    """A dense component needs no round of its edges, whole or in stretches."""
    monkeypatch.setattr(merging, "_told", None)
    rnd = np.random.default_rng(4)
    n, photo = 12, [f"p{i % 5}" for i in range(12)]
    vec = np.array([1.0, 0, 0, 0]) + rnd.normal(size=(n, 4)) * 0.3
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    edges = [(a, b, float(1 - unit[a] @ unit[b])) for a in range(n) for b in range(a + 1, n)][:: 1 if stretch > 12 else 3]
    found = constrained_groups(spark.createDataFrame([(i, vec[i].tolist(), photo[i]) for i in range(n)], "idx long, vec array<double>, photo_id string"), spark.createDataFrame(edges, "l long, r long, dist double"), 0.3, stretch).collect()
    assert [r.root for r in sorted(found, key=lambda r: r.idx)] == scanned(vec, photo, edges, 0.3)


def test_rounds_without_stretches(spark):
    """What no task could hold is left to the rounds."""
    rows, edges, want = graphs(6, 2)
    anchors = spark.createDataFrame(rows, "idx long, vec array<double>, photo_id string")
    found = constrained_groups(anchors, spark.createDataFrame(edges, "l long, r long, dist double"), 0.3, 0).collect()
    assert [r.root for r in sorted(found, key=lambda r: r.idx)] == want


def test_without_edges_or_rows(spark):
    assert grouped(spark, [(4, [1.0, 0.0], "a"), (2, [1.0, 0.0], None)], [], 0.5) == [2, 4]
    assert grouped(spark, [], [], 0.5) == []


@pytest.mark.parametrize("complete", [0.2, 2.0])
def test_large_groups_are_compared_by_blocks(spark, complete):
    """Two groups of several blocks each, with one pair too far apart."""
    rnd = np.random.default_rng(5)
    left = np.array([1.0, 0.0]) + rnd.normal(size=(300, 2)) * [0.001, 0.05]
    right = np.array([1.0, 0.35]) + rnd.normal(size=(300, 2)) * [0.001, 0.05]
    vec = np.concatenate([left, right])
    edges = [(0, i, 1e-6 * i) for i in range(1, 300)] + [(300, 300 + i, 1e-6 * i) for i in range(1, 300)] + [(5, 305, 0.01)]
    photo = [None] * 600
    rows = [(i, vec[i].tolist(), None) for i in range(600)]
    assert grouped(spark, rows, edges, complete) == scanned(vec, photo, edges, complete)
