"""Conversation and text-quality analytics expressed as Spark DataFrame jobs."""
