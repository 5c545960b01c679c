"""Operators for large text corpora: quality, near copies, tokens, shards, secrets, language.

Nothing outside this package imports it.
"""
