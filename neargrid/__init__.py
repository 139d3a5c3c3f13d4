"""Nearest-neighbour search analytics on Spark."""
