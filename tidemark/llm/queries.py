"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules, secret_scan
from .bpe_trie import op13_bpe_roundtrip
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_layout import op10_html_extraction
from .importance_resampling import OP12_SQL, op12_importance_resampling
from .lm_scoring import op3_lm_scoring
from .mixing import OP7_SQL, op7_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .packing import op6_packing
from .permutation_index import op8_permutation_index
from .quality_classifier import op1_quality_classifier
from .quality_rules import op2_quality_rules
from .secret_scan import op4_secret_scan
from .token_files import op5_token_files

OPERATORS: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_quality_classifier,
    op2_quality_rules,
    op3_lm_scoring,
    op4_secret_scan,
    op5_token_files,
    op6_packing,
    op7_mixing,
    op8_permutation_index,
    op9_near_dedup,
    op10_html_extraction,
    op11_hard_negatives,
    op12_importance_resampling,
    op13_bpe_roundtrip,
)

#: Columns of operators that SQL can express where it cannot express the whole operator.
BASES = {quality_rules.quality_base_counts: quality_rules.BASE_COUNTS_SQL, secret_scan.secret_base_counts: secret_scan.BASE_COUNTS_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, *BASES)}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op9_near_dedup": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_importance_resampling": OP12_SQL} | {f.__name__: sql for f, sql in BASES.items()}
