"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this package.  Every operator takes
and returns DataFrames; ``queries`` holds the thin registered queries.
"""
