"""Registered queries by family; importing this package registers them all."""

from millrace.queries import batches, facts, logs_jobs, market, notes, pages, retrieval, streams, sync  # noqa: F401
from millrace.queries.registry import CHECKS, QUERIES  # noqa: F401
