"""Readers of supplier feeds."""
