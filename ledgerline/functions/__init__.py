"""Scalar functions: normalisers, parsers, predicates and classifiers, as column expressions."""
