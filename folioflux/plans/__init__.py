"""Whole plans: page parsing, the record pipeline, and the queries on the driver's tables."""
