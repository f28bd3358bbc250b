"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op10_bpe
from .decontaminate import OP1_SQL, op1_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .language import op3_language_id
from .packing import op13_packing
from .periodic import OP12_SQL, op12_periodic_runs
from .preferences import OP4_SQL, op4_preferences
from .quality import op8_quality
from .simhash import op6_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op9_toxicity
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_preferences": op4_preferences,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_packing": op13_packing,
}

ORACLES = {
    "op1_decontamination": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op4_preferences": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op12_periodic_runs": OP12_SQL,
}
