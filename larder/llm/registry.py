"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat
from .decontaminate import op5_decontamination
from .html_text import op3_html
from .merkle import OP13_SQL, op13_merkle
from .packing import op4_packing
from .parts import PERSONAL_BASE_SQL, QUALITY_COUNTS_SQL, personal_base, quality_counts
from .pii import op8_pii
from .quality_model import op6_quality
from .quality_rules import op7_quality_rules
from .repair import OP11_SQL, op11_repair
from .simhash import op10_simhash
from .substrings import OP1_SQL, op1_substring_dedup
from .suffixes import OP12_SQL, op12_suffixes
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_html": op3_html,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_quality_rules": op7_quality_rules,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
    "op11_repair": op11_repair,
    "op12_suffixes": op12_suffixes,
    "op13_merkle": op13_merkle,
    "quality_counts": quality_counts,
    "personal_base": personal_base,
}

ORACLES: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op9_chat": OP9_SQL, "op11_repair": OP11_SQL, "op12_suffixes": OP12_SQL, "op13_merkle": OP13_SQL, "quality_counts": QUALITY_COUNTS_SQL, "personal_base": PERSONAL_BASE_SQL}
