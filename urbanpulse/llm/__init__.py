"""Operators for training-data preparation: tokens, near-duplicates, filters and privacy.

Nothing else in the library imports this package; `__spark_entry__.py` adds its queries when
the package is there.
"""
