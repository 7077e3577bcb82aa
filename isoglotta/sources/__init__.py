"""Datasets, raw layouts and sinks."""
