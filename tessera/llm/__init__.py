"""Operators of a training-data pipeline: dedup, tokens, extraction, scoring, packing.

Nothing else in the library imports this subpackage.
"""
