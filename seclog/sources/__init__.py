"""Readers that turn captured telemetry into log entries or attempts."""
