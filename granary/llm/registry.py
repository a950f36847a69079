"""Queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from .binary_ids import op6_binary_ids
from .fingerprint import op2_document_fingerprints
from .language_model import op7_language_model
from .licences import op9_licence_scan
from .minhash import op10_near_duplicates
from .mixing import op3_mixing
from .oracles import ORACLES
from .packing import op4_packing
from .phrases import op11_phrases
from .pieces import op13_pieces
from .quality import op5_quality_rules
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op8_suffix_dedup
from .vector_codes import op12_vector_codes

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_binary_ids": op6_binary_ids,
    "op7_language_model": op7_language_model,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_licence_scan": op9_licence_scan,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_phrases": op11_phrases,
    "op12_vector_codes": op12_vector_codes,
    "op13_pieces": op13_pieces,
}

__all__ = ["ORACLES", "QUERIES"]
