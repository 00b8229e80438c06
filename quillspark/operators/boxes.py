"""Boxes on pages: greedy suppression by quality, and merging of boxes that touch until none do.

Boxes (page, box, x0, y0, x1, y1) meet by grid cells, not by whole pages. Both operators run in rounds of joins, in which
what is decided does not depend on how rows are dealt; their results equal those of the loops over one page.

Written tables of boxes are many times larger in memory than as Parquet, and more so in grid cells. So every join here asks for a
merge: by the size of the files Spark would take such tables for small, and gather them in the driver for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tables import free_shuffles, written

CELL = 200


def cells(boxes: DataFrame, margin: int = 0, cell: int = CELL) -> DataFrame:
    """A row for each grid cell that a box, or its surroundings of `margin`, touches: cx, cy."""
    span = lambda a, b: F.sequence(F.floor((F.col(a) - margin) / cell), F.floor((F.col(b) + margin) / cell))
    return boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def area(p: str) -> Column:
    return F.greatest(F.lit(0), F.col(f"{p}x1") - F.col(f"{p}x0")) * F.greatest(F.lit(0), F.col(f"{p}y1") - F.col(f"{p}y0"))


def shared_area(p: str, q: str) -> Column:
    w = F.least(F.col(f"{p}x1"), F.col(f"{q}x1")) - F.greatest(F.col(f"{p}x0"), F.col(f"{q}x0"))
    h = F.least(F.col(f"{p}y1"), F.col(f"{q}y1")) - F.greatest(F.col(f"{p}y0"), F.col(f"{q}y0"))
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def meeting(boxes: DataFrame, extra: list[str], margin: int = 0, cell: int = CELL) -> DataFrame:
    """Pairs of different boxes of a page that share a cell, columns prefixed a_ and b_, once for each pair and direction.

    A pair counts in the cell that holds its first shared cell only, so nothing has to be made distinct.
    """
    names = ["box", "x0", "y0", "x1", "y1", *extra]
    low = {c: F.floor((F.col(c) - margin) / cell) for c in ("x0", "y0")}
    dealt = cells(boxes, margin, cell).select("page", "cx", "cy", *names, low["x0"].alias("fx"), low["y0"].alias("fy"))
    a, b = (dealt.select("page", "cx", "cy", *(F.col(c).alias(f"{p}_{c}") for c in (*names, "fx", "fy"))) for p in "ab")
    first = (F.col("cx") == F.greatest("a_fx", "b_fx")) & (F.col("cy") == F.greatest("a_fy", "b_fy"))
    return a.join(b.hint("merge"), ["page", "cx", "cy"]).where((F.col("a_box") != F.col("b_box")) & first).drop("cx", "cy", "a_fx", "a_fy", "b_fx", "b_fy")


def quality(score: Column, visual: Column, textual: Column, box_area: Column) -> Column:
    """Fixed values of the ranking: visual likeness adds, likeness to text takes away, and so does a very large area."""
    return score + 0.28 * visual - 0.20 * textual + F.when(box_area < 900_000, 0.035).otherwise(0.0)


def suppress(boxes: DataFrame, rounds: int = 1000) -> DataFrame:
    """boxes (page, box, x0, y0, x1, y1, score, visual, textual) with quality, kept and, where not kept, suppressed_by.

    In the order of quality (then visual, less textual, smaller area, smaller box id) a box stays unless one that stayed
    before covers it: shared area at least 0.58 of the union; or 0.90 of it inside one that is no smaller, if its quality is
    at most 0.08 above; or 0.94 of the other inside it, if it is over 1.18 times as large and its quality at most 0.12 above.
    suppressed_by is the first such box in that order.

    Each round keeps the boxes without an open or kept coverer and drops those with a kept one; the first open box of a page
    is always decided, and what is left is written once a round. box is unique in a page; boxes without a page or with a
    null coordinate cover nothing and stay. No boxes: none.
    """
    ranked = boxes.withColumns({"area": area(""), "quality": F.round(quality(F.col("score"), F.col("visual"), F.col("textual"), area("")), 9)})
    # Smaller is better; nulls of a rank count as the worst.
    order = lambda p: F.struct(*(F.coalesce(c, F.lit(float("inf"))) for c in (-F.col(f"{p}quality"), -F.col(f"{p}visual"), F.col(f"{p}textual"), F.col(f"{p}area").cast("double"))), F.col(f"{p}box"))
    whole = F.col("page").isNotNull() & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    pairs = meeting(ranked.where(whole), ["area", "quality", "visual", "textual"])
    both = shared_area("a_", "b_")
    inside = both / F.greatest(F.lit(1), F.col("b_area"))
    around = both / F.greatest(F.lit(1), F.col("a_area"))
    union = both / F.greatest(F.lit(1), F.col("a_area") + F.col("b_area") - both)
    covers = (union >= 0.58) & (both > 0)
    covers |= (inside >= 0.90) & (F.col("b_area") <= F.col("a_area")) & (F.col("b_quality") <= F.col("a_quality") + 0.08)
    covers |= (around >= 0.94) & (F.col("b_area") > F.col("a_area") * 1.18) & (F.col("b_quality") <= F.col("a_quality") + 0.12)
    edges = written(pairs.where((order("a_") < order("b_")) & covers).select("page", F.col("a_box").alias("above"), F.col("b_box").alias("box"), order("a_").alias("rank")), "box-edges")
    open_edges, dropped = edges, None
    for _ in range(rounds):
        if open_edges.isEmpty():
            break
        # A box that is above another and below none stays: what it covers goes.
        below = open_edges.select("page", F.col("box").alias("above")).distinct()
        sure = open_edges.join(below.hint("merge"), ["page", "above"], "left_anti")
        gone = sure.groupBy("page", "box").agg(F.min("rank").alias("rank"))
        dropped = written(gone if dropped is None else dropped.unionByName(gone), "box-dropped")
        lost = dropped.select("page", "box").hint("merge")
        # Edges from what is gone cover nothing, edges to it are settled.
        open_edges = written(open_edges.join(lost, ["page", "box"], "left_anti").join(lost.withColumnRenamed("box", "above").hint("merge"), ["page", "above"], "left_anti"), "box-edges")
    else:
        raise RuntimeError("suppression did not settle")
    if dropped is None:
        return boxes.select("*", ranked_quality(boxes), F.lit(True).alias("kept"), F.lit(None).cast(boxes.schema["box"].dataType).alias("suppressed_by"))
    # Of all that stayed, the first one that covers it.
    stayed = edges.join(dropped.select("page", F.col("box").alias("above")).hint("merge"), ["page", "above"], "left_anti")
    by = stayed.groupBy("page", "box").agg(F.min_by("above", "rank").alias("suppressed_by"))
    return boxes.select("*", ranked_quality(boxes)).join(by.hint("merge"), ["page", "box"], "left").withColumn("kept", F.col("suppressed_by").isNull())


def ranked_quality(boxes: DataFrame) -> Column:
    return F.round(quality(F.col("score"), F.col("visual"), F.col("textual"), area("")), 9).alias("quality")


def merge(boxes: DataFrame, margin: int, width: int, height: int, rounds: int = 200) -> DataFrame:
    """page, x0, y0, x1, y1, boxes: boxes united while one, widened by margin within the page, meets another.

    The result is the same in any order of uniting, since unions only grow; `boxes` counts the rows united, and so adds up to
    all rows. Boxes lie inside the page (0 to width, 0 to height), and touching edges alone don't meet. Rows with a null are
    left out. No boxes: none.

    In each round every box joins the smallest box (in reading order) that it meets; only pages that changed go on.
    """
    whole = boxes.dropna(subset=["page", "x0", "y0", "x1", "y1"])
    coordinates = ["x0", "y0", "x1", "y1"]
    current = whole.groupBy("page", *coordinates).agg(F.count("*").alias("boxes"))
    done = None
    current = written(current.withColumn("box", F.struct("y0", "x0", "y1", "x1")), "boxes")
    for _ in range(rounds):
        reach = {"x0": F.greatest(F.lit(0), F.col("a_x0") - margin), "y0": F.greatest(F.lit(0), F.col("a_y0") - margin), "x1": F.least(F.lit(width), F.col("a_x1") + margin), "y1": F.least(F.lit(height), F.col("a_y1") + margin)}
        touch = (F.col("b_x0") < reach["x1"]) & (reach["x0"] < F.col("b_x1")) & (F.col("b_y0") < reach["y1"]) & (reach["y0"] < F.col("b_y1"))
        met = meeting(current, [], margin).where(touch).select("page", F.col("a_box").alias("box"), F.col("b_box").alias("other"))
        # Either of the two may be the one that reaches the other.
        both = met.unionByName(met.select("page", F.col("other").alias("box"), F.col("box").alias("other")))
        to = written(both.groupBy("page", "box").agg(F.min("other").alias("to")), "box-links")
        free_shuffles(boxes.sparkSession)
        if to.isEmpty():
            return current.select("page", *coordinates, "boxes") if done is None else done.unionByName(current.select("page", *coordinates, "boxes"))
        changed = to.select("page").distinct().hint("merge")
        still = current.join(changed, "page", "left_anti").select("page", *coordinates, "boxes")
        done = written(still if done is None else done.unionByName(still), "boxes-done")
        moving = current.join(changed, "page", "left_semi").join(to.hint("merge"), ["page", "box"], "left").withColumn("group", F.least("box", F.coalesce("to", "box")))
        united = moving.groupBy("page", "group").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("boxes").alias("boxes")).drop("group")
        # Boxes united into one and the same box are one.
        united = united.groupBy("page", *coordinates).agg(F.sum("boxes").alias("boxes"))
        current = written(united.withColumn("box", F.struct("y0", "x0", "y1", "x1")), "boxes")
        free_shuffles(boxes.sparkSession)
    raise RuntimeError("boxes did not settle")
