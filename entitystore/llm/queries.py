"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_dedup
from .cotraining import op5_quality_classifier
from .decontamination import op8_benchmark_decontamination
from .html_extraction import op9_html_extraction
from .line_dedup import op10_line_dedup
from .packing import op3_best_fit_packing
from .quality_rules import op2_quality_rules
from .sanitisation import op4_information_sanitisation
from .simhash import op6_simhash_near_dedup
from .suffix_dedup import op7_suffix_array_dedup
from .token_counts import op1_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality_rules": op2_quality_rules,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_information_sanitisation": op4_information_sanitisation,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_html_extraction": op9_html_extraction,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_benchmark_decontamination": decontamination.SQL,
        "op10_line_dedup": line_dedup.SQL,
    }
