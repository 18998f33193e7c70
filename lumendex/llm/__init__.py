"""Operators of a large-scale training-data pipeline.

Each module holds one operator with a general interface; ``contract.py`` derives
the registered queries from them. Nothing outside this package imports it but
the guarded lookup in ``__spark_entry__.py``.
"""
