"""Readers, source mappers and sinks."""
