"""Operators for preparing training data: each module is one operator, queries.py applies them to the tables."""
