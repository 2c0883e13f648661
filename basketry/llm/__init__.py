"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries and ``__spark_entry__`` adds them only when it can be imported.
"""
