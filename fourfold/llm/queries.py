"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .classifier import op8_quality_classifier
from .divergence import OP13_SQL, op13_source_divergence
from .encoding import op9_sentencepiece
from .language import op2_language_id
from .linededup import op3_line_dedup
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP7_SQL, op7_mixing
from .neardup import op10_near_duplicates
from .neighbours import op6_nearest_neighbours
from .rules import op1_quality_rules
from .sharding import op5_sharding
from .substrings import OP11_SQL, op11_substring_dedup
from .tokencount import op4_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_language_id": op2_language_id,
        "op3_line_dedup": op3_line_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_sharding": op5_sharding,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_mixing": op7_mixing,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": OP7_SQL, "op11_substring_dedup": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_divergence": OP13_SQL}
