"""Operators for training-data pipelines.

Each module holds one operator with its own general interface; ``queries`` registers the thin
``opN_*`` queries over the given tables.  Nothing outside this folder imports it, except the
guarded hook in ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
