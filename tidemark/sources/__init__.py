"""Readers, stores and sinks."""
