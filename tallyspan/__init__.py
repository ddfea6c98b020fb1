"""Snapshot-and-ledger analytics as DataFrame operators on PySpark."""
