"""Column-level building blocks (no jobs are run here)."""
