"""The queries of this subpackage and their DuckDB SQL, by name."""

from . import jaccard_join, language_id, license_scan, mixing, multi_index, packing, preference, token_counts, url_filter

QUERIES = {
    "op1_embedding_dedup": multi_index.op1_embedding_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_language_id": language_id.op3_language_id,
    "op4_sequence_packing": packing.op4_sequence_packing,
    "op5_nearest_neighbours": multi_index.op5_nearest_neighbours,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_preference_format": preference.op8_preference_format,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_license_scan": license_scan.op10_license_scan,
}

ORACLES = {
    "op1_embedding_dedup": multi_index.LINKS_SQL,
    "op6_source_mixing": mixing.ORACLE,
    "op8_preference_format": preference.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
}
