"""Imports every module of registered queries; see :mod:`candlespark.plans.registry`."""

from candlespark.plans.registry import ORACLE, QUERIES  # noqa: F401
from candlespark.plans import evaluation_queries, feature_queries, model_queries, monitor_queries, split_queries, store_queries, stream_queries  # noqa: F401,E402
