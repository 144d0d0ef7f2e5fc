"""All registered queries of the library proper."""

from stratalake.plans import learning, soils, sources, spatial  # noqa: F401  registers
from stratalake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
