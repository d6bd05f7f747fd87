"""Imports every query module, which registers its queries."""

from adtrail.llm import q_chats, q_divergence, q_licenses, q_maxent, q_minhash, q_mixing, q_mtree, q_pages, q_pieces, q_quality, q_spellings, q_suffixes, q_tokens  # noqa: F401
from adtrail.llm.registry import QUERIES, SQL  # noqa: F401
