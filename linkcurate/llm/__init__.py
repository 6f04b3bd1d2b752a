"""Operators for preparing training data: one module each, and the queries over the driver's tables."""
