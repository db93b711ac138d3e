"""Index construction, queries, summaries and merges."""
