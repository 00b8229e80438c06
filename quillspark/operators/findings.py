"""Data-quality rules that yield findings: one row for each broken rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: code, severity, the condition under which a row breaks the rule.
Rule = tuple[str, str, Column]


def findings(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """keys, severity, code; a condition that is null counts as not broken. One pass, no shuffle."""
    broken = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for code, s, c in rules]))
    return df.select(*keys, F.explode(broken).alias("f")).select(*keys, "f.severity", "f.code")
