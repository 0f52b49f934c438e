"""The corpus operators' queries and their SQL."""

from . import decontam, exact_dedup, language_id, mixing, ngram_join, secret_scan, sharding, subword_lm, suffix_dedup, toxicity


def queries():
    return {
        "op1_hilbert_shards": sharding.op1_hilbert_shards,
        "op2_poisson_mix": mixing.op2_poisson_mix,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_subword_lm": subword_lm.op4_subword_lm,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_language_id": language_id.op6_language_id,
        "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql():
    return {
        "op2_poisson_mix": mixing.OP2_SQL,
        "op3_ngram_join": ngram_join.OP3_SQL,
        "op7_benchmark_decontamination": decontam.OP7_SQL,
        "op9_suffix_dedup": suffix_dedup.OP9_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
    }
