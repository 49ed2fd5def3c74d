"""Datasets, snapshots and transactions, and the reads and writes that they offer."""
