"""Detectors and annotators: DataFrame -> DataFrame, usable with ``.transform``."""
