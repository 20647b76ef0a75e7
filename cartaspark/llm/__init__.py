"""Operators that prepare text corpora for language-model training.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
