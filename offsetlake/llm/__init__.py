"""Operators of a training-data pipeline: archives, token files, search, filters, mixing, packing.

Nothing else in the library imports this subpackage.
"""
