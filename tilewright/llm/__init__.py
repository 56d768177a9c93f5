"""Operators that prepare training text: tokenising, scoring, de-duplication, filtering and formatting.

Each module holds one operator with a general interface and, below it, the thin ``opN_`` query over the
standard tables. Nothing outside this package imports it.
"""
