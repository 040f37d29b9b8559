"""DataFrame -> DataFrame operators: cleaning, labels, features, metrics, tests, models."""
