"""Incremental ingest as a stream of new document files."""
