"""Queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .decontaminate import op1_decontaminate
from .fertility import op6_fertility_rules
from .jaccard_join import OP2_SQL, op2_jaccard_join
from .lm_score import op9_lm_score
from .quality import op5_quality
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_counts import op10_token_counts
from .toxicity import op8_toxicity
from .warc import OP7_SQL, op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_decontaminate, op2_jaccard_join, op3_bpe, op4_substring_dedup, op5_quality, op6_fertility_rules, op7_warc, op8_toxicity, op9_lm_score, op10_token_counts)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op2_jaccard_join": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op7_warc": OP7_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
