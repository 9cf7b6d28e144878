"""Operators for preparing training data at scale.

Each module holds one operator with an interface of its own; ``queries`` binds
them to the given tables. Nothing else in the library imports this package.
"""
