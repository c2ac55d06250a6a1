"""Incremental delivery of snapshots."""
