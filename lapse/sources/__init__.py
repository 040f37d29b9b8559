"""Readers, dataset adapters, the dataset registry and result sinks."""
