"""Operators of a training-data pipeline: deduplication, archives, tokens, mixing and text models.

``queries()`` and ``oracle_sql()`` hold one entry ``opN_<name>`` for each operator.
"""
