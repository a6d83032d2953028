"""Queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_byte_bpe
from .chat import OP7_SQL, op7_preference_format
from .fingerprint import op6_fingerprints
from .lm import op10_pseudo_likelihood
from .ngram import op2_ngram_join
from .packing import op1_packing
from .pii import op4_pii
from .quality import OP5_SQL, op5_quality_rules
from .suffix import op8_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_pii": op4_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_fingerprints": op6_fingerprints,
    "op7_preference_format": op7_preference_format,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
}
ORACLES: dict[str, str] = {"op5_quality_rules": OP5_SQL, "op7_preference_format": OP7_SQL}
