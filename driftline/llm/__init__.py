"""Operators of a training-data pipeline: rules, models, near duplicates, tokens, mixing, archives."""
