"""Operators of a training-data pipeline: mixing, counting, deduplication, scoring, decontamination.

Nothing else in the library imports this subpackage.
"""
