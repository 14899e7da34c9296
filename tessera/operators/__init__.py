"""Relational, search and mutation operators over DataFrames."""
