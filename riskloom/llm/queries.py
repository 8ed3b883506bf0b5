"""The queries of this subpackage and their DuckDB SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from riskloom.llm import conversation_repair, exact_dedup, html_extraction, jaccard_join, line_dedup, mixing, packing, pii, quality, secrets, spotsigs, token_store, vector_codes

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_store": token_store.op6_token_store,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_packing": packing.op8_packing,
    "op9_quality": quality.op9_quality,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_html_extraction": html_extraction.op13_html_extraction,
    "spotsigs_similar": spotsigs.spotsigs_similar,
}

SQL = {
    "op1_secret_scan": secrets.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_mixing": mixing.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_html_extraction": html_extraction.SQL,
}
