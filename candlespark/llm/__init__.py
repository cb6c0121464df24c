"""Operators of a training-data pipeline; see the table in the README.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
