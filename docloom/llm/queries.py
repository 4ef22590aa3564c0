"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .class_model import op5_class_model
from .decontaminate import OP1_SQL, op1_benchmark_decontamination
from .jaccard_join import op7_ngram_jaccard_join
from .language import op6_language_id
from .packing import op8_best_fit_packing
from .ranked_search import OP12_SQL, op12_ranked_search
from .secrets import op2_secret_scans
from .suffix_dedup import op4_suffix_array_dedup
from .token_counts import op3_token_counts
from .toxicity import op11_toxicity
from .transport import op9_transport_streams
from .url_filter import op10_url_filters
from .vector_codes import OP13_SQL, op13_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> f(spark, sf_dir)."""
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_secret_scans, op3_token_counts, op4_suffix_array_dedup, op5_class_model, op6_language_id, op7_ngram_jaccard_join, op8_best_fit_packing, op9_transport_streams, op10_url_filters, op11_toxicity, op12_ranked_search, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"op1_benchmark_decontamination": OP1_SQL, "op12_ranked_search": OP12_SQL, "op13_vector_codes": OP13_SQL}
