"""Operators for preparing training data: filters, near-duplicate joins,
decontamination, archives, token files, packing and sharding.

Each operator takes and returns DataFrames and lives in a module of its own;
``queries.py`` registers one query per operator over the driver tables. No
module outside this package imports it.
"""
