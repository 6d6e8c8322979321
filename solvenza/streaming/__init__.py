"""Structured Streaming forms of the grade, alert and feature flows."""
