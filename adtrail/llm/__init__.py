"""Operators for preparing training text; see README.md in this folder."""
