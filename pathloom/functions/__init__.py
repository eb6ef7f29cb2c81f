"""Expressions: types, operators and functions as Spark columns."""
