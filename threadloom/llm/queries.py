"""Registry of this package's queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_token_alignment
from .lm import op13_lm_scoring
from .mixing import op5_mixing
from .near import op3_ngram_jaccard_join
from .packing import op8_packing
from .quality import op7_quality_rules
from .secrets import op6_secret_scans
from .sharding import op10_sharding
from .substrings import op9_substring_dedup
from .topk import op2_exact_topk
from .token_counts import op4_token_counts
from .url_filters import op1_url_filters
from .whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_exact_topk, op3_ngram_jaccard_join, op4_token_counts, op5_mixing, op6_secret_scans, op7_quality_rules, op8_packing, op9_substring_dedup, op10_sharding,
        op11_token_alignment, op12_whitening, op13_lm_scoring,
    )
}

#: DuckDB SQL of the queries that it can express.
ORACLES: dict[str, str] = {}
