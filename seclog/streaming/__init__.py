"""Structured Streaming forms of the sources and stateful detectors."""
