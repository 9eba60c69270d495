"""Operators that prepare training data at corpus scale.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in ``__spark_entry__.py``
depends on it.
"""
