"""Queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontamination import OP6_SQL, op6_decontamination
from quillspark.llm.fill_middle import OP12_SQL, op12_fill_middle
from quillspark.llm.jaccard_join import OP4_SQL, op4_jaccard_join
from quillspark.llm.line_dedup import OP8_SQL, op8_line_dedup
from quillspark.llm.merkle import OP13_SQL, op13_merkle_manifest
from quillspark.llm.packing import op3_packing
from quillspark.llm.pii import op9_personal_data
from quillspark.llm.quality import op2_quality
from quillspark.llm.suffix_tree import op7_suffix_tree
from quillspark.llm.token_files import op5_token_files
from quillspark.llm.toxicity import op11_toxicity
from quillspark.llm.url_filter import OP10_SQL, op10_url_filters
from quillspark.llm.warc import OP1_SQL, op1_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_quality": op2_quality,
        "op3_packing": op3_packing,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_token_files": op5_token_files,
        "op6_decontamination": op6_decontamination,
        "op7_suffix_tree": op7_suffix_tree,
        "op8_line_dedup": op8_line_dedup,
        "op9_personal_data": op9_personal_data,
        "op10_url_filters": op10_url_filters,
        "op11_toxicity": op11_toxicity,
        "op12_fill_middle": op12_fill_middle,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op4_jaccard_join": OP4_SQL,
        "op6_decontamination": OP6_SQL,
        "op8_line_dedup": OP8_SQL,
        "op10_url_filters": OP10_SQL,
        "op12_fill_middle": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
