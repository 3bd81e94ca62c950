"""The queries of this subpackage and, where SQL can express them, the SQL."""

from __future__ import annotations

from . import exact_dedup, fingerprints, golden_records, jaccard_join, language_id, license_scan, packing, piece_codec, prefix_trie, quality_rules, substring_dedup, token_counts, vector_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_piece_codec": piece_codec.op4_piece_codec,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_packing": packing.op10_packing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_vector_dedup": vector_dedup.op12_vector_dedup,
    "op13_golden_records": golden_records.op13_golden_records,
}
ORACLES = {"op2_substring_dedup": substring_dedup.OP2_SQL, "op8_jaccard_join": jaccard_join.OP8_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op11_prefix_trie": prefix_trie.OP11_SQL, "op12_vector_dedup": vector_dedup.OP12_SQL, "op13_golden_records": golden_records.OP13_SQL}
