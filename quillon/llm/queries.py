"""The registered queries of the training-data operators, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, langid, lattice_sampling, mixing, multi_index, ngram_join, packing, secrets, sharding, token_alignment, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_packing": packing.op1,
    "op2_gumbel_segmentation": lattice_sampling.op2,
    "op3_secret_scan": secrets.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_multi_index": multi_index.op5,
    "op6_toxicity_chain": toxicity.op6,
    "op7_url_filter": url_filter.op7,
    "op8_ngram_jaccard": ngram_join.op8,
    "op9_language_id": langid.op9,
    "op10_sharding": sharding.op10,
    "op11_source_mixing": mixing.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_token_alignment": token_alignment.op13,
    "packed_conversations": packing.packed_conversations,
    "segmentation_round_trip": lattice_sampling.segmentation_round_trip,
    "secret_counts": secrets.secret_counts,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op8_ngram_jaccard": ngram_join.OP8_SQL,
    "op11_source_mixing": mixing.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "segmentation_round_trip": lattice_sampling.ROUND_TRIP_SQL,
    "secret_counts": secrets.COUNTS_SQL,
}
