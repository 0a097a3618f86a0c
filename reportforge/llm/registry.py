"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op8_byte_bpe
from .divergence import OP11_SQL, op11_source_divergence
from .hpylm import op7_lm_scores
from .jaccard import OP4_SQL, op4_ngram_jaccard
from .licences import op5_licence_scan
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op3_packing
from .quality import op9_quality_rules
from .sharding import op13_sharding
from .shards import op6_token_shards
from .token_counts import op10_token_counts
from .topk import OP1_SQL, op1_topk
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_licence_scan": op5_licence_scan,
    "op6_token_shards": op6_token_shards,
    "op7_lm_scores": op7_lm_scores,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op1_topk": OP1_SQL, "op2_line_dedup": OP2_SQL, "op4_ngram_jaccard": OP4_SQL, "op11_source_divergence": OP11_SQL, "op12_vector_codes": OP12_SQL,
}
