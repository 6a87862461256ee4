"""Whole plans over the input tables: views, and the flagship reconciliation."""
