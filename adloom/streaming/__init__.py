"""Structured Streaming: the ledger with keyed state or by micro-batch, profile upserts, deduplication."""
