"""Operators on readings, cells and localities."""
