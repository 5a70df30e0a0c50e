"""Readers of signals, telemetry and readings."""
