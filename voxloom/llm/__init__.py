"""Operators of a training-data pipeline: sharding, filtering, de-duplication, tokenising.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
