"""Workflows composed from operators: runs, gates, sweeps, sensitivity, driver queries."""
