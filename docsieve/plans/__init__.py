"""Whole operations on a DataFrame of files, and the registered queries."""
