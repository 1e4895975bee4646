"""Ledger reconciliation as Spark DataFrame jobs.

Every public function takes and returns DataFrames or Columns. Nothing here
collects rows to the driver; loops that need a stop condition read one count.
"""

__version__ = "0.1.0"
