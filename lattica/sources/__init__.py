"""Inputs: the driver's parquet tables, program tables, MPS files."""
