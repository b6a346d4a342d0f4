"""Comparison of a stream of snapshots with a fixed one."""
