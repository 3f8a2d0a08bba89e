"""Operators of a training-data pipeline: decontamination, deduplication, mixing, scans and scoring."""
