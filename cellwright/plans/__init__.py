"""Whole comparisons: snapshots in, results out."""
