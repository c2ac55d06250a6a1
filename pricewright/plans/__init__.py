"""Query plans over the synthetic tables, with their SQL."""
