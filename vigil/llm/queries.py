"""The registry of this package: thin queries over the driver's tables, and
their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from . import (compression, decontaminate, exact_dedup, langid, lattice, ngram_join, packing, quotes, resampling,
               revisits, sentence_dedup, toxicity, vector_codes)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sentence_dedup": sentence_dedup.op2_sentence_dedup,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_langid": langid.op6_langid,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_quality": compression.op8_quality,
    "op9_revisits": revisits.op9_revisits,
    "op10_quotes": quotes.op10_quotes,
    "op11_resampling": resampling.op11_resampling,
    "op12_lattice": lattice.op12_lattice,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op7_ngram_join": ngram_join.OP7_SQL,
    "op9_revisits": revisits.OP9_SQL,
    "op10_quotes": quotes.OP10_SQL,
    "op12_lattice": lattice.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
