"""Readers that turn tables into the library's entities, and the sinks."""
