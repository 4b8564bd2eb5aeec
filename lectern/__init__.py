"""Passage lookup, corpus building, content scanning and reference detection on Spark."""
