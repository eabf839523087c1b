"""Operators of a training-data pipeline, one module per operator.

Nothing outside this package imports it; its queries are in ``queries``.
"""
