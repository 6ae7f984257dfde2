"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_cluster
from .chat_format import OP5_SQL, op5_chat_format
from .decontaminate import OP8_SQL, op8_decontaminate
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .html_extract import op4_html_extract
from .licenses import op13_licenses
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixture import op1_mix_sources
from .near_join import op6_near_join
from .phrases import OP11_SQL, op11_phrases
from .quality import op10_quality
from .repeats import op7_suffix_dedup
from .token_count import op3_token_count

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op10_quality": op10_quality,
    "op6_near_join": op6_near_join,
    "op3_token_count": op3_token_count,
    "op4_html_extract": op4_html_extract,
    "op5_chat_format": op5_chat_format,
    "op11_phrases": op11_phrases,
    "op12_cluster": op12_cluster,
    "op13_licenses": op13_licenses,
}

ORACLES = {
    "op8_decontaminate": OP8_SQL,
    "op9_line_dedup": OP9_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op5_chat_format": OP5_SQL,
    "op11_phrases": OP11_SQL,
    "op12_cluster": OP12_SQL,
}
