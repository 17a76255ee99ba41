"""Operators of a training-data pipeline: formatting, quality, scoring, dedup, mixing, encoding."""
