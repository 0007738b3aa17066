"""Append-only logs as streams. The reference has none; this goes beyond it."""
