"""Operators of a training-data pipeline: filters, models, near-duplicates, decontamination, PII and mixing."""
