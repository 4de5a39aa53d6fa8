"""Operators for building training corpora: fingerprints, deduplication, language, quality, mixing and tokens.

Nothing outside this package imports it; the rest of the library works without it.
"""
