"""Rolling rates from a ring of slots, as keyed state of constant size.

A scope has SLOTS slots of one second each. A second writes to the slot of its remainder and stamps it; a slot that an older second holds is overwritten, one that
a newer second holds refuses the older one. So late and disordered input changes a slot only while no newer round of the ring has reached it, and
the state of a scope is three arrays, whatever passes through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenfold.sources.storage import fresh_path
from lumenfold.streaming.lifecycle import rocksdb

SLOTS, WINDOW = 120, 30
EMPTY = -(1 << 62)
OUT = "scope long, now long, images long, faces long, images_per_s double, faces_per_s double, version long"


def per_second(n: int, spent: int) -> float:
    """n / spent to three places, halves away from zero as in SQL; in integers, so that no half is lost."""
    size = (2000 * abs(n) + spent) // (2 * spent) / 1000
    return size if n >= 0 else -size


class Ring:
    """The slots of one scope: second, images and faces of each."""

    def __init__(self, second: list[int] | None = None, images: list[int] | None = None, faces: list[int] | None = None) -> None:
        self.second = np.full(SLOTS, EMPTY, np.int64) if second is None else np.array(second, np.int64)
        self.images, self.faces = (np.zeros(SLOTS, np.int64) if x is None else np.array(x, np.int64) for x in (images, faces))

    def add(self, second: int, images: int, faces: int) -> bool:
        """Count for a second; False if the slot has moved on."""
        slot = second % SLOTS
        if second < self.second[slot]:
            return False
        if second > self.second[slot]:
            self.second[slot], self.images[slot], self.faces[slot] = second, 0, 0
        self.images[slot] += images
        self.faces[slot] += faces
        return True

    def read(self, now: int) -> tuple[int, int, float, float]:
        """Images, faces and both a second over the window that ends now; its length begins at the first second seen in it. Seconds after now do not count."""
        seen = (self.second > now - WINDOW) & (self.second <= now)
        if not seen.any():
            return 0, 0, 0.0, 0.0
        spent = max(1, min(WINDOW, now - int(self.second[seen].min()) + 1))
        images, faces = int(self.images[seen].sum()), int(self.faces[seen].sum())
        return images, faces, per_second(images, spent), per_second(faces, spent)


class Rates(StatefulProcessor):
    """A ring for each scope, read at the latest second that it has seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "second array<long>, images array<long>, faces array<long>, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        *held, version = self.ring.get() if self.ring.exists() else (None, None, None, 0)
        ring = Ring(*held)
        for part in rows:
            whole = part.dropna(subset=["second"]).fillna({"images": 0, "faces": 0}).astype({"second": "int64", "images": "int64", "faces": "int64"})
            for second, images, faces in whole.groupby("second", sort=True)[["images", "faces"]].sum().itertuples():
                ring.add(second, int(images), int(faces))
        now = int(ring.second.max())
        self.ring.update((ring.second.tolist(), ring.images.tolist(), ring.faces.tolist(), version + 1))
        if now > EMPTY:
            images, faces, per_image, per_face = ring.read(now)
            yield pd.DataFrame({"scope": [key[0]], "now": [now], "images": [images], "faces": [faces], "images_per_s": [per_image], "faces_per_s": [per_face], "version": [version + 1]})

    def close(self) -> None:
        """Nothing is held beside the state."""


def run(counts: DataFrame, sink: str, marks: str) -> None:
    """Take a stream of counts (scope, second, images, faces) to its end; readings go to the table sink, progress to marks."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/micro_batch={number}")  # a repeated micro-batch replaces itself

    read = counts.select("scope", "second", "images", "faces").groupBy("scope").transformWithStateInPandas(Rates(), OUT, "Update", "None")
    with rocksdb(counts.sparkSession):
        read.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def latest(df: DataFrame) -> DataFrame:
    """The last reading of each scope."""
    shown = [c.split()[0] for c in OUT.split(", ")[1:-1]]
    return df.groupBy("scope").agg(F.max_by(F.struct(*shown), "version").alias("x")).select("scope", "x.*")


def rates(counts: DataFrame) -> DataFrame:
    """Each scope's rates after the whole stream."""
    spark = counts.sparkSession
    sink = fresh_path(spark, "sink")
    run(counts, sink, fresh_path(spark, "marks"))
    return latest(spark.read.schema(OUT).parquet(sink))
