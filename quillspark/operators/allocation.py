"""Greedy allocation along each source, in which what was allocated before makes later rows redundant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tables import written

#: Fixed values of the ladder: potential, richness, categories and redundancy that an allocation asks for.
SKIPPED = ("ADMINISTRATIVE", "TRANSITION_SLIDE")
TWICE_TYPES = ("HIGH_YIELD_CLINICAL", "MECHANISM")
VISUAL_TYPES = ("IMAGE_HEAVY", "TABLE_HEAVY")
REASONS = ("low information or administrative", "sufficient yield and distinct content", "high yield, rich, low redundancy", "image or table has question value")


def _ladder(redundancy: Column) -> tuple[Column, Column]:
    """Count and reason at a redundancy; the count never rises with it."""
    has = lambda types: F.arrays_overlap("types", F.array(*map(F.lit, types)))
    potential, richness = F.col("potential"), F.col("richness")
    twice = (potential >= 85) & (richness >= 12) & (F.col("categories") >= 2) & (redundancy < 0.35) & has(TWICE_TYPES)
    once = (potential >= 50) & (richness >= 3) & (redundancy < 0.80)
    visual = has(VISUAL_TYPES) & (potential >= 40) & (redundancy < 0.85)
    count = F.when(has(SKIPPED), 0).when(twice, 2).when(once, 1).when(visual, 1).otherwise(0)
    reason = F.when(has(SKIPPED), REASONS[0]).when(twice, REASONS[2]).when(once, REASONS[1]).when(visual, REASONS[3]).otherwise(REASONS[0])
    return count, reason


def allocate(rows: DataFrame, rounds: int = 1000) -> DataFrame:
    """source, position, count, reason, redundancy of each row, as if rows were taken in order, source by source.

    rows: source, position (unique in its source), potential, richness, categories, types and keys (arrays of strings). Redundancy is
    the larger of two shares of a row's distinct keys: those that stand in over one row of the source, and those of which
    an earlier row of the source was allocated something. Without keys it is 0. Null arrays are empty, null numbers 0, a null
    source is one source. No rows: none.

    Rows are decided in rounds instead of one after the other. A key counts as taken once an earlier row with it is
    decided above 0, as free once all earlier rows with it are decided at 0, and as open else; a row is decided when its
    count is the same with all of its open keys taken and with none. The first open row of a source always is, and a
    common key is settled for all later rows by one of them. A round joins the open rows' keys with one minimum for each
    key, so no source or key comes together in a task, and nothing but whether rows are left reaches the driver.
    """
    arrays = {c: F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in ("types", "keys")}
    numbers = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("potential", "richness", "categories")}
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    base = rows.select(src.alias("src"), F.col("position").cast("long").alias("position"), *(c.alias(n) for n, c in (arrays | numbers).items()))
    base = written(base.withColumn("n", F.size("keys")), "allocation-rows")
    spread = base.select("src", "position", F.explode("keys").alias("key"))
    repeated = spread.groupBy("src", "key").agg(F.count("*").alias("rows")).where("rows > 1").select("src", "key")
    # A key of one row only is neither repeated nor ever taken.
    spread = written(spread.join(repeated, ["src", "key"]), "allocation-keys")
    seen = spread.groupBy("src", "position").agg(F.count("*").alias("shared"))
    facts = base.drop("keys").join(seen, ["src", "position"], "left").withColumn("prior", F.when(F.col("n") > 0, F.coalesce("shared", F.lit(0)) / F.col("n")).otherwise(0.0)).drop("shared")
    todo = written(facts, "allocation-open")
    taken = done = None
    for _ in range(rounds):
        keys = spread.join(todo.select("src", "position"), ["src", "position"], "left_semi")
        waiting = keys.groupBy("src", "key").agg(F.min("position").alias("waits"))
        state = keys.join(waiting, ["src", "key"])
        state = state.withColumn("first", F.lit(None).cast("long")) if taken is None else state.join(taken, ["src", "key"], "left")
        is_taken = F.coalesce(F.col("first") < F.col("position"), F.lit(False))
        is_open = ~is_taken & (F.col("waits") < F.col("position"))
        sums = state.groupBy("src", "position").agg(F.count_if(is_taken).alias("sure"), F.count_if(is_taken | is_open).alias("most"))
        share = lambda c: F.greatest("prior", F.when(F.col("n") > 0, F.coalesce(c, F.lit(0)) / F.col("n")).otherwise(0.0))
        bounds = todo.join(sums, ["src", "position"], "left").withColumns({"low": share("sure"), "high": share("most")})
        judged = written(bounds.withColumns({"count": _ladder(F.col("low"))[0], "other": _ladder(F.col("high"))[0]}), "allocation-round")
        # What is decided keeps its exact redundancy only if no key is open any more, so that is worked out at the end.
        sure = judged.where("count = other").select("src", "position", "count")
        done = sure if done is None else done.unionByName(sure)
        todo = judged.where("count <> other").drop("sure", "most", "low", "high", "count", "other")
        given = spread.join(sure.where("count > 0"), ["src", "position"]).groupBy("src", "key").agg(F.min("position").alias("first"))
        taken = written(given if taken is None else taken.unionByName(given).groupBy("src", "key").agg(F.min("first").alias("first")), "allocation-taken")
        if todo.isEmpty():
            break
    else:
        raise RuntimeError("allocation did not settle")
    hits = spread.join(taken, ["src", "key"]).where("first < position").groupBy("src", "position").agg(F.count("*").alias("hits"))
    settled = facts.join(done, ["src", "position"]).join(hits, ["src", "position"], "left")
    redundancy = F.greatest("prior", F.when(F.col("n") > 0, F.coalesce("hits", F.lit(0)) / F.col("n")).otherwise(0.0))
    return settled.select(F.expr("substr(nullif(src, ''), 2)").alias("source"), "position", F.col("count").cast("long").alias("count"), _ladder(redundancy)[1].alias("reason"), F.round(redundancy, 3).alias("redundancy"))
