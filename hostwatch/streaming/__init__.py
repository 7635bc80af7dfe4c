"""Structured Streaming forms of sessionising, host baselines and alerts."""
