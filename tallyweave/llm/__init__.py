"""Operators of a training-data pipeline: quality, copies, secrets, pages, archives, token files, mixing.

Each operator takes DataFrames and column names and returns a DataFrame. The
modules read only the columns they name, so other columns of the input may have
any name. ``registry.py`` holds the thin queries over the driver's tables.
"""
