"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import (
    bpe_trie,
    chat_format,
    decontamination,
    filter_audit,
    jaccard_join,
    license_scan,
    packing,
    quality_classifier,
    quality_rules,
    secret_scans,
    substring_dedup,
    token_alignment,
    token_counts,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_secret_scans": secret_scans.op8_secret_scans,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_packing": packing.op10_packing,
    "op11_bpe_trie": bpe_trie.op11_bpe_trie,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op8_secret_scans": secret_scans.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
