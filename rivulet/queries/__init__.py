"""Registered queries with their SQL."""

from rivulet.plans.registry import ORACLES, QUERIES
from rivulet.queries import events, live, processing, streams

__all__ = ["ORACLES", "QUERIES", "events", "live", "processing", "streams"]
