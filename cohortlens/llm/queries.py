"""Registry of the corpus operators' queries and, where SQL can say them, their DuckDB SQL."""

from __future__ import annotations

from cohortlens.llm import (
    ann, decontam, jaccard, licenses, lm, merkle, mixing, periodic, quality, sharding, simple8b, substring, toxicity,
)

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_lm": lm.op2_lm,
    "op3_mixing": mixing.op3_mixing,
    "op4_simple8b": simple8b.op4_simple8b,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontam": decontam.op7_decontam,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_quality": quality.op9_quality,
    "op10_substring": substring.op10_substring,
    "op11_periodic": periodic.op11_periodic,
    "op12_merkle": merkle.op12_merkle,
    "op13_ann": ann.op13_ann,
}

ORACLE = {
    "op1_licenses": licenses.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op7_decontam": decontam.OP7_SQL,
    "op8_jaccard": jaccard.OP8_SQL,
    "op10_substring": substring.OP10_SQL,
    "op12_merkle": merkle.OP12_SQL,
}
