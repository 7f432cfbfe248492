"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import hnsw, htmltext, lines, mixing, pii, quality, topk
from chronofold.llm.packing import op8_best_fit
from chronofold.llm.records import op4_token_records
from chronofold.llm.simhash import op3_simhash_golay


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_importance_resampling": quality.op1_importance_resampling, "op2_ball_tree": topk.op2_ball_tree, "op3_simhash_golay": op3_simhash_golay, "op4_token_records": op4_token_records, "op5_tag_paths": htmltext.op5_tag_paths, "op6_pfair": mixing.op6_pfair, "op7_hnsw": hnsw.op7_hnsw, "op8_best_fit": op8_best_fit, "op9_line_hashing": lines.op9_line_hashing, "op10_crf": pii.op10_crf}


def oracle_sql() -> dict[str, str]:
    return {"op2_ball_tree": topk.ORACLE_SQL, "op6_pfair": mixing.ORACLE_SQL, "op7_hnsw": hnsw.ORACLE_SQL}
