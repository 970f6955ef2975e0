"""Evidence-graph analytics on Spark: documents, facts with character spans,
bi-temporal queries, reversible resolution, usage ledgers and extraction scoring."""
