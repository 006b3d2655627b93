"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import search
from .bpe import op11_byte_level_bpe
from .chat import op2_chat_formatting
from .decontaminate import op10_benchmark_decontamination
from .lines import op1_line_dedup
from .lm import op4_lm_scoring
from .packing import op8_packing
from .quality import op3_quality_classifier
from .rules import op5_quality_rules
from .search import op12_ranked_search
from .simhash import op6_simhash_near_dedup
from .suffix_dedup import op9_suffix_array_dedup
from .token_counts import op7_token_counts
from .whitening import op13_embedding_whitening

QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_line_dedup,
    op2_chat_formatting,
    op3_quality_classifier,
    op4_lm_scoring,
    op5_quality_rules,
    op6_simhash_near_dedup,
    op7_token_counts,
    op8_packing,
    op9_suffix_array_dedup,
    op10_benchmark_decontamination,
    op11_byte_level_bpe,
    op12_ranked_search,
    op13_embedding_whitening,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op12_ranked_search": search.SQL}
