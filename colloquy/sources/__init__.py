"""Schemas, readers, sinks and the views derived from the raw tables."""
