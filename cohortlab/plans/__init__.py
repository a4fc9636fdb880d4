"""Named queries over the survey view, each with a DuckDB oracle where SQL can express it."""

from cohortlab.plans import awkward, bundles, cleaning, encoding, invariants, io, models, overview, segments  # noqa: F401  (registers)
from cohortlab.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
