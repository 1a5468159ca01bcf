"""Operators for training-data pipelines: scans, classifiers, search, deduplication, extraction and tokenizing."""
