"""The registered queries."""

from txnflow.checks import models, relational, storage, streams
from txnflow.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "models", "relational", "storage", "streams"]
