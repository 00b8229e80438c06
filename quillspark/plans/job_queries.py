"""Queries that SQL cannot express in full: sequential chunkers and streams replayed over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import chunkers
from quillspark.plans.registry import query


@query("C01_chunks")
def c01(t):
    return chunkers.chunk_documents(t("documents"))


@query("C05_segments")
def c05(t):
    return chunkers.text_segments(t("documents"), 200)


@query("C09_question_blocks")
def c09(t):
    """Numbers and letters put before sentences make items of plain texts."""
    numbered = F.concat(F.lit("1. "), F.regexp_replace("text", r"\. ", ".\nA) "))
    return chunkers.question_blocks(t("documents").select("doc_id", numbered.alias("text")))
