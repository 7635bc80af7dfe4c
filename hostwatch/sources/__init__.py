"""Readers, sinks and table adapters."""
