"""Operators over DataFrames: each takes DataFrames or Columns and returns them, lazily."""
