"""Operators for preparing training data for language models.

Nothing outside this package imports it; ``queries`` registers one query per operator and ``corpus_pipeline`` at the top of
the repository chains four of them.
"""
