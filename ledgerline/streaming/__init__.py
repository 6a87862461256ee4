"""Streams: append-only events to status projections."""
