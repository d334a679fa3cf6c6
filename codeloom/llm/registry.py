"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op7_bpe
from .chat import op10_chat_format
from .decontamination import op12_decontamination
from .filters import OP13_SQL, op13_filter_audit
from .langid import op6_language_id
from .licenses import op8_license_scan
from .mixing import op1_mixing
from .neighbours import op9_nearest
from .quality import op4_quality_rules
from .simhash import op2_simhash_near_dedup
from .toxicity import op3_toxicity
from .urls import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_bpe": op7_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_nearest": op9_nearest,
    "op10_chat_format": op10_chat_format,
    "op11_alignment": op11_alignment,
    "op12_decontamination": op12_decontamination,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": OP5_SQL,
    "op13_filter_audit": OP13_SQL,
}
