"""All registered queries of this package."""

from panelyard.llm import (  # noqa: F401
    exact_topk, html_extraction, language_id, ngram_join, packing, piece_encoding, quality_classifier, quality_rules, token_alignment, token_counts,
    url_filters, vector_codes, warc,
)
from panelyard.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
