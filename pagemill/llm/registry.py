"""All queries of this subpackage."""

from __future__ import annotations

from pagemill.llm import (
    html_extract,
    mixing,
    near_dedup,
    quality_model,
    quality_rules,
    secret_scan,
    sentence_pieces,
    spelling_variants,
    substring_dedup,
    token_counts,
    topk_search,
    url_filter,
    whitening,
)

_MODULES = [
    near_dedup,
    html_extract,
    url_filter,
    substring_dedup,
    token_counts,
    topk_search,
    sentence_pieces,
    quality_rules,
    quality_model,
    mixing,
    spelling_variants,
    whitening,
    secret_scan,
]
QUERIES = {name: both for module in _MODULES for name, both in module.QUERIES.items()}
