"""Registered queries, by area."""

from . import evaluation, finance, ingestion, kpis, layout, mutations, parsers, relational, retrieval, rules, service, stores, streams, texts, usage, workflow  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
