"""Capture-recapture survey analytics as Spark DataFrame operators."""
