"""Queries over the given tables and the SQL that checks them."""

from workload import chains, collection, flow, history, landing, streams, studies, texts  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
