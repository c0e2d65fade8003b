"""Operators for preparing large text corpora, each a Spark job of its own.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
