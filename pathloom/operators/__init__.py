"""Statements' operators: pattern matching, paths, selection, modification."""
