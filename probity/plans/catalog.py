"""All registered queries of the engine, by name."""

from __future__ import annotations

from probity.plans import audits, console, contributors, evidence, ledger, logs, receipts, streams, vectors
from probity.plans.query import Query

QUERIES: dict[str, Query] = {**contributors.QUERIES, **ledger.QUERIES, **vectors.QUERIES, **console.QUERIES, **audits.QUERIES, **evidence.QUERIES, **logs.QUERIES, **receipts.QUERIES, **streams.QUERIES}
