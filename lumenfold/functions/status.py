"""Status, processor and phase expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def processor(name: Column) -> Column:
    """cpu, gpu or mixed; anything else is unknown."""
    low = F.lower(name)
    return F.when(low.isin("cpu", "gpu", "mixed"), low).otherwise(F.lit("unknown"))


def merged(held: Column, new: Column) -> Column:
    """Processor of a batch after one more item."""
    return F.when(held.isNull(), new).when(held == new, held).otherwise(F.lit("mixed"))


def phase(status: Column, error: Column) -> Column:
    """What a user sees of a status; an error goes before."""
    return (
        F.when(error.isNotNull(), "failed").when(status.isin("queued", "receiving"), "waiting").when(status == "processing", "analysing")
        .when(status == "finalizing", "grouping").when(status.isin("succeeded", "skipped"), "done").otherwise(F.lit("failed"))
    )


def finished(failed: Column, total: Column) -> Column:
    """Outcome of a batch whose items are all terminal."""
    return F.when(failed >= total, "failed").when(failed > 0, "partial_failed").otherwise(F.lit("completed"))
