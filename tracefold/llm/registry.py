"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tracefold.llm import byte_bpe, conversation_trie, decontaminate, fingerprint, hmm_lm, html_main, jaccard_join, line_dedup, mixing, quality, spelling, suffix_dedup, url_filter

MODULES = (line_dedup, hmm_lm, decontaminate, fingerprint, mixing, html_main, quality, suffix_dedup, jaccard_join, url_filter, byte_bpe, spelling, conversation_trie)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
