"""All registered queries."""

from . import curves, evaluation, features, ingest, ledgers, research, signals, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
