"""Relational operators: matching, checks, retrieval, audit."""
