"""User functions for SQL: scalar, table and aggregate ones, registered by name for a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Scalar and table functions are SQL themselves, so Catalyst inlines them and pushes filters through.
SQL_FUNCTIONS = {
    "normalize_key": "(s STRING) RETURNS STRING RETURN lower(trim(regexp_replace(s, '[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+', ' ')))",
    "clamp_text": "(s STRING, n INT) RETURNS STRING RETURN substr(trim(regexp_replace(s, '[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+', ' ')), 1, n)",
    "letter_grade": "(p DOUBLE) RETURNS STRING RETURN CASE WHEN p >= 90 THEN 'A' WHEN p >= 80 THEN 'B' WHEN p >= 70 THEN 'C' WHEN p >= 60 THEN 'D' ELSE 'F' END",
    "text_lines": "(s STRING) RETURNS TABLE (k BIGINT, line STRING) RETURN SELECT CAST(pos + 1 AS BIGINT) AS k, col AS line FROM posexplode(split(s, '\\\\n'))",
}


def register(spark: SparkSession) -> list[str]:
    """Registers normalize_key, clamp_text, letter_grade (scalar), text_lines (table) and typical_text (aggregate); their names.

    typical_text is the text of a group whose length is nearest to the group's median, the first of equal ones in order; it is
    an Arrow aggregate, so one group's texts are in memory at a time. Registering again replaces.
    """
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")

    @F.pandas_udf("string")
    def typical_text(texts: pd.Series) -> str:
        known = texts.dropna().sort_values()
        if known.empty:
            return None
        away = (known.str.len() - known.str.len().median()).abs()
        return known[away == away.min()].iloc[0]

    spark.udf.register("typical_text", typical_text)
    return [*SQL_FUNCTIONS, "typical_text"]
