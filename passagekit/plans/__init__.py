"""Composite plans: ingestion, index build and the retrieval queries, put together from operators."""
