"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage; ``registry`` names its
queries for the driver contract in ``__spark_entry__.py``.
"""
