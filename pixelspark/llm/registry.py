"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, divergence, exact_dedup, lexical_search, license_scan, mixture_language, near_dedup, packing, pii, quality, sentencepiece_bpe, sharding, url_filter

MODULES = (sentencepiece_bpe, chat, quality, pii, packing, url_filter, exact_dedup, lexical_search, license_scan, mixture_language, near_dedup, sharding, lexical_search, mixture_language, divergence)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
