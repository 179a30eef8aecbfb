"""Operators for large-scale training-data preparation.

Nothing outside this folder (and the guarded hook in ``__spark_entry__``)
imports it; it can be deleted without touching the rest of the library.
"""
