"""Operators that prepare training text for language models.

Nothing else in the library imports this subpackage. ``queries`` registers one query per operator;
``corpus_pipeline.py`` at the top of the repository chains five of them.
"""
