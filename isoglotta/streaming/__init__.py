"""Incremental maintenance of cells."""
