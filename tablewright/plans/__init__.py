"""Distributed building blocks: one-scan statistics, frequencies, exact quantiles, order cuts."""
