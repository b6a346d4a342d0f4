"""Compare two snapshots of a dataset cell by cell, on Spark."""

VERSION = "0.2.0"
