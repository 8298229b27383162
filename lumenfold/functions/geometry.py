"""Boxes, views and scores. Boxes are structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    both = side("x1", "x2") * side("y1", "y2")
    area = lambda x: F.greatest(F.lit(0.0), x["x2"] - x["x1"]) * F.greatest(F.lit(0.0), x["y2"] - x["y1"])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def suppressed(boxes: Column, most: float) -> Column:
    """Boxes (struct of score, idx, x1 to y2) that greedy suppression keeps: best score first, then index; one stays if it overlaps none that stayed by `most` or more."""
    order = F.array_sort(boxes, lambda p, q: F.when(p["score"] > q["score"], -1).when(p["score"] < q["score"], 1).otherwise(F.signum((p["idx"] - q["idx"]).cast("double")).cast("int")))
    return F.aggregate(order, F.slice(order, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: iou(k, x) >= most), kept).otherwise(F.array_append(kept, x)))


def tiles(width: Column, height: Column, trigger: int = 1600, overlap: float = 0.12) -> Column:
    """Views of an image: all of it, and two by two overlapping tiles if its longest edge reaches the trigger."""
    share = max(0.0, min(0.4, overlap))
    w, h = F.ceil(width * (0.5 + share / 2)).cast("int"), F.ceil(height * (0.5 + share / 2)).cast("int")
    view = lambda x, y, right, bottom: F.struct(x.cast("int").alias("left"), y.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))
    zero = F.lit(0)
    whole = view(zero, zero, width, height)
    four = F.array(whole, view(zero, zero, w, h), view(width - w, zero, width, h), view(zero, height - h, w, height), view(width - w, height - h, width, height))
    return F.when(F.greatest(width, height) >= trigger, four).otherwise(F.array(whole))


def quality(confidence: Column, size: Column, sharpness: Column, exposure: Column, pose: Column) -> Column:
    """Quality score from parts in [0, 1]."""
    return F.sqrt(confidence * size) * (0.70 + 0.20 * sharpness + 0.10 * exposure) * (0.80 + 0.20 * pose)
