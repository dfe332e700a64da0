"""Query catalogue. Importing the package registers every query."""

from . import q_slice, q_sources, q_functions, q_features, q_metrics, q_alarms, q_models, q_streaming  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
