"""Structured Streaming forms of the ledger, the quotas and the ingestion."""
