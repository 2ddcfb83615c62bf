"""Operators of a training-data pipeline: cleaning, near-duplicates, packing, token files.

Each module holds one operator with its own general interface. ``queries.py`` registers one query per
operator and its SQL. Nothing outside this package imports it, except ``__spark_entry__.py``.
"""
