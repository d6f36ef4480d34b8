"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusloom.llm import binary_output, conversations, exact_dedup, language, licenses, mixing, packing, pii, quality, search, secrets, simhash, topk

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_topk": topk.op5_topk,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_pii": pii.op7_pii,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_quality": quality.op9_quality,
    "op10_token_output": binary_output.op10_token_output,
    "op11_language": language.op11_language,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_ranked_search": search.op13_ranked_search,
}

SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_topk": topk.OP5_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op12_conversation_repair": conversations.OP12_SQL,
    "op13_ranked_search": search.OP13_SQL,
}
