"""Readers, nested-record flattening and sinks."""
