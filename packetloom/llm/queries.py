"""The named queries of this subpackage, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import decontaminate, divergence, embeddings, interactions, mainhtml, minhash, packing, quality, rules, sharding, suffixes, tokencount, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op10_lexical_retrieval_packing": packing.op10_lexical_retrieval_packing,
    "op8_minimum_cut_html": mainhtml.op8_minimum_cut_html,
    "op9_collision_counting": embeddings.op9_collision_counting,
    "op3_prefix_free_parsing": suffixes.op3_prefix_free_parsing,
    "op7_sequential_bayesian_minhash": minhash.op7_sequential_bayesian_minhash,
    "op6_gzip_normaliser": warc.op6_gzip_normaliser,
    "op1_factorisation_machine_quality": quality.op1_factorisation_machine_quality,
    "op2_prefix_filtered_decontamination": decontaminate.op2_prefix_filtered_decontamination,
    "op4_permutation_sharding": sharding.op4_permutation_sharding,
    "op5_rank_synchronous_tokens": tokencount.op5_rank_synchronous_tokens,
    "op11_filter_interactions": interactions.op11_filter_interactions,
    "op12_learned_decision_list": rules.op12_learned_decision_list,
    "op13_late_string_divergence": divergence.op13_late_string_divergence,
}

ORACLES: dict[str, str] = {
    "op3_prefix_free_parsing": suffixes.ORACLE,
    "op9_collision_counting": embeddings.ORACLE,
    "op7_sequential_bayesian_minhash": minhash.ORACLE,
    "op6_gzip_normaliser": warc.ORACLE,
    "op2_prefix_filtered_decontamination": decontaminate.ORACLE,
    "op4_permutation_sharding": sharding.ORACLE,
    "op11_filter_interactions": interactions.ORACLE,
    "op13_late_string_divergence": divergence.ORACLE,
}
