"""Operators for building training corpora at scale.

Nothing outside this package imports it; ``queries.register`` lists what it
offers to the entry point.
"""
