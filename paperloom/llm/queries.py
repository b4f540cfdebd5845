"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import decontam, katz, langid, mixing, neardup, repair, secrets, sharding, suffixdup, topk, trie, urls, wavelet

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_language_mixture": langid.op2_language_mixture,
    "op3_katz_score": katz.op3_katz_score,
    "op4_top_k": topk.op4_top_k,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_suffix_dedup": suffixdup.op7_suffix_dedup,
    "op8_url_filter": urls.op8_url_filter,
    "op9_token_output": wavelet.op9_token_output,
    "op10_poisson_mix": mixing.op10_poisson_mix,
    "op11_byte_shards": sharding.op11_byte_shards,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_structure_repair": repair.op13_structure_repair,
}
SQL = {"op4_top_k": topk.OP4_SQL, "op6_secret_scan": secrets.OP6_SQL, "op1_decontaminate": decontam.OP1_SQL, "op10_poisson_mix": mixing.OP10_SQL, "op11_byte_shards": sharding.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_structure_repair": repair.OP13_SQL}
