"""Corpora of simulation trajectory frames on Spark: ingest, screening, dedup, extraction, sharding, export."""

from framewright.operators.corpus import Corpus, join_corpora, join_shards, split_shards
from framewright.plans.select import Select

__all__ = ["Corpus", "Select", "join_corpora", "join_shards", "split_shards"]
