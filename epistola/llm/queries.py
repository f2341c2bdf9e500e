"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .audit import op12_source_audit
from .ctw import op13_context_tree
from .decontam import op9_decontamination
from .lexical import op11_lexical_search
from .licenses import op2_license_scan
from .linededup import op10_line_dedup
from .nbsvm import op5_quality_classifier
from .ngramjoin import op1_ngram_jaccard_join
from .oracles import ORACLE_SQL
from .packing import op4_harmonic_packing
from .pii import op6_pii_sanitisation
from .quality_rules import op7_quality_rules
from .toxicity import op8_toxicity
from .warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_license_scan, op3_warc, op4_harmonic_packing, op5_quality_classifier, op6_pii_sanitisation, op7_quality_rules, op8_toxicity, op9_decontamination, op10_line_dedup, op11_lexical_search, op12_source_audit, op13_context_tree)}
__all__ = ["ORACLE_SQL", "QUERIES"]
