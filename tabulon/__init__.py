"""Tabulon: single-table analytics in a MySQL dialect, on Spark DataFrames."""
