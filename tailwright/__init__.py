"""Spark jobs for incremental transcript ingestion."""
