"""Groups of items that share one list of options: an instruction binds the next items, which inherit what they lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSTRUCTION = r"(?i)\b(?:options?|choices?)\b.*\bnext (\d{1,9}) items?\b"
OPTION = r"^\s*([A-Z])[).]\s+(.*)$"
STEM = r"^\s*\d+[.)]\s+"


def parsed(items: DataFrame) -> DataFrame:
    """set_id, number, span (items that the instruction names, or null), shared, options and stem of items (set_id, number, lines).

    shared: the lines between the instruction, or the beginning, and the first option, if options come before the stem.
    stem: the lines from the one with a number on, without options; without such a line, all that are neither options nor instruction.
    """

    def is_option(x: Column) -> Column:
        return x.rlike(OPTION)

    def is_instruction(x: Column) -> Column:
        return x.rlike(INSTRUCTION)

    def is_stem(x: Column) -> Column:
        return x.rlike(STEM) & ~is_instruction(x)

    lines = F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    option = lambda x: F.struct(F.regexp_extract(x, OPTION, 1).alias("label"), F.trim(F.regexp_extract(x, OPTION, 2)).alias("text"))
    df = items.select("set_id", "number", lines.alias("lines"))

    def first(found: Column) -> Column:
        """The first line for which found is true, from 0; null without one."""
        place = F.array_position(found, True)
        return F.when(place > 0, place - 1)

    df = df.withColumns({
        "first_option": first(F.transform("lines", is_option)), "first_stem": first(F.transform("lines", is_stem)),
        "instruction": F.get(F.filter("lines", is_instruction), F.lit(0)), "options": F.transform(F.filter("lines", is_option), option),
    })
    before = (F.col("first_option") < F.col("first_stem")) & F.col("first_option").isNotNull()
    shared = F.filter("lines", lambda x, k: (k < F.col("first_option")) & ~is_instruction(x))
    stem = F.filter("lines", lambda x, k: (k >= F.coalesce("first_stem", F.lit(0))) & ~is_option(x) & ~is_instruction(x))
    return df.select(
        "set_id", "number", F.nullif(F.regexp_extract("instruction", INSTRUCTION, 1), F.lit("")).cast("long").alias("span"),
        F.when(before, F.nullif(F.array_join(shared, " "), F.lit(""))).alias("shared"), "options", F.regexp_replace(F.array_join(stem, " "), STEM, "").alias("stem"),
    )


def grouped(items: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Items with the options they have or inherit.

    items: set_id, number, lines (an array of strings), one row an item. Result: set_id, number, stem, options (label,
    text), source (own, group or none), grouped, range_start, range_end, shared, and with answers (set_id, number, correct)
    correct and key_valid, whether that letter is among the options.

    An instruction `next N items` binds its item and the N - 1 numbers after it, up to the next instruction of the set. A
    member without options gets the binding item's; one with the same options is a member too; one with others, like every
    item outside a range, keeps its own and is not grouped. A binding item without options binds nothing. Null sets or
    numbers are in no group; repeated numbers are members each; empty tables give none. Ranges are expanded into numbers
    and joined on (set_id, number): a set of any size is spread, and ranges end where the next begins, so no more
    numbers are made than the set's highest one, or one for each binding item.
    """
    rows = parsed(items)
    heads = rows.where("span > 0 AND set_id IS NOT NULL AND number IS NOT NULL AND size(options) > 0")
    # One binding row for a number; where several say so, the first by span and text.
    heads = heads.groupBy("set_id", F.col("number").alias("range_start")).agg(F.min(F.struct("span", "shared", "options")).alias("h")).select("set_id", "range_start", "h.*")
    next_start = F.lead("range_start").over(Window.partitionBy("set_id").orderBy("range_start"))
    last = rows.groupBy("set_id").agg(F.max("number").alias("last"))
    end = F.least(F.col("range_start") + F.col("span") - 1, F.col("next_start") - 1, F.col("last"))
    ranges = heads.withColumn("next_start", next_start).join(last, "set_id").select("set_id", "range_start", end.alias("range_end"), F.col("shared").alias("bank_shared"), F.col("options").alias("bank"))
    bound = ranges.withColumn("number", F.explode(F.sequence("range_start", "range_end")))
    joined = rows.join(bound, ["set_id", "number"], "left")
    own = F.size("options") > 0
    member = F.col("range_start").isNotNull() & (~own | (F.col("options") == F.col("bank")))
    out = joined.select(
        "set_id", "number", "stem", F.when(own, F.col("options")).when(member, F.col("bank")).otherwise(F.col("options")).alias("options"),
        F.when(own, "own").when(member, "group").otherwise("none").alias("source"), member.alias("grouped"),
        *(F.when(member, F.col(c)).alias(c) for c in ("range_start", "range_end")), F.coalesce("shared", F.when(member, F.col("bank_shared"))).alias("shared"),
    )
    if answers is None:
        return out
    keys = answers.groupBy("set_id", "number").agg(F.min("correct").alias("correct"))
    return out.join(keys, ["set_id", "number"], "left").withColumn("key_valid", F.coalesce(F.exists("options", lambda o: o["label"] == F.col("correct")), F.lit(False)))
