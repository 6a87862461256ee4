"""Scans and sinks: files by content, configured JSON, HTML tables, deduplicated downloads."""
