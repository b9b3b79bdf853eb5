"""Structured Streaming forms of the record operators: nonces, freshness, chains,
an append-only log, and re-audits of new batches."""
