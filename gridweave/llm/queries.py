"""The training-data queries and what SQL can say about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .quality import op8_quality_classifier
from .topk import OP10_SQL, op10_exact_top_k
from .toxicity import op4_toxicity
from .katz import op1_katz_lm_scoring
from .neardup import OP9_SQL, op9_minhash_near_dedup
from .chat import OP7_SQL, op7_chat_formatting
from .decontaminate import OP2_SQL, op2_benchmark_decontamination
from .packing import op3_best_fit_packing

from .urlfilter import op5_url_filter
from .warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_lm_scoring": op1_katz_lm_scoring,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op8_quality_classifier": op8_quality_classifier,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_chat_formatting": op7_chat_formatting,
    "op10_exact_top_k": op10_exact_top_k,
    "op3_best_fit_packing": op3_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": OP2_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_exact_top_k": OP10_SQL,
    "op6_warc": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
}
