"""Operators for training-data pipelines (near duplicates, boilerplate, quality, leaks, mixing, sentences).

Nothing outside this package imports it; ``QUERIES`` and ``SQL`` are picked up by ``__spark_entry__`` when present.
"""
