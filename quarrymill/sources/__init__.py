"""Readers, renderers and sinks."""
