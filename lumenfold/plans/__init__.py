"""Named queries; importing the package registers all of them."""

from lumenfold.plans import geometry, ingest, relational, scalars, similarity, streams, telemetry
from lumenfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "geometry", "ingest", "relational", "scalars", "similarity", "streams", "telemetry"]
