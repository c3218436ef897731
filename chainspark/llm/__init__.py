"""Operators for preparing large text corpora: scoring, de-duplication, search, mixing, tokenising, sharding.

Nothing outside this subpackage imports it.
"""
