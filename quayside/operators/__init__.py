"""Relational operators over registry tables: DataFrames in, lazy DataFrames out."""
