"""Registry of this package's queries and of their SQL."""

from __future__ import annotations

from .bpe import op9_bpe
from .chat import OP5_SQL, op5_chat
from .html_text import op2_html_text
from .interleaved import op3_media
from .language_id import op8_language_id
from .licenses import OP11_SQL, op11_licenses
from .packing import op4_packing
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .text_join import op10_text_join
from .toxicity import op6_toxicity
from .url_filter import op1_url_filter
from .vector_dedup import OP7_SQL, op7_vector_dedup
from .whitening import op12_whitening

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_html_text": op2_html_text,
    "op3_media": op3_media,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_language_id": op8_language_id,
    "op9_bpe": op9_bpe,
    "op10_text_join": op10_text_join,
    "op11_licenses": op11_licenses,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op5_chat": OP5_SQL,
    "op7_vector_dedup": OP7_SQL,
    "op11_licenses": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
