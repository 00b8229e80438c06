"""Packers: pages into chunks of bounded size, and items into batches bounded by number and cost.

Both are folds over ordered rows that hold no more than what is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspark.operators.tables import slices, written


def page_units(pages: DataFrame, cap: int) -> DataFrame:
    """doc_id, page, tie (a hash of the page's text), unit (from 1), text, fresh, figures: a page is one unit, a longer one than cap one for each paragraph.

    Paragraphs lie between blank lines; fresh marks the first one of an oversized page, which begins a chunk. figures are
    the page's, with its first unit.
    """
    strip = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    none = F.array().cast("array<string>")
    rows = pages.select("doc_id", "page", strip(F.col("text")).alias("text"), F.coalesce("figures", none).alias("figures")).where("text <> ''").withColumn("tie", F.xxhash64("text"))
    paragraphs = F.filter(F.transform(F.split("text", r"\n{2,}"), strip), lambda p: p != "")
    over = F.char_length("text") > cap
    cut = rows.select("doc_id", "page", "tie", "figures", over.alias("over"), F.posexplode(F.when(over, paragraphs).otherwise(F.array("text"))).alias("at", "text"))
    return cut.select("doc_id", "page", "tie", (F.col("at") + 1).alias("unit"), "text", (F.col("over") & (F.col("at") == 0)).alias("fresh"), F.when(F.col("at") == 0, F.col("figures")).otherwise(none).alias("figures"))


CHUNK = "doc_id long, chunk long, page_start long, page_end long, n_chars long, text string, figures array<string>"


def pack_pages(pages: DataFrame, cap: int = 12_000) -> DataFrame:
    """CHUNK: pages merged in order while they fit into cap characters.

    pages: doc_id, page, text and figures (an array of strings), one row a page; other columns are ignored. Pages are
    stripped and joined by a blank line; blank ones, and their figures, are left out. A page longer than cap begins a chunk
    and is packed by paragraphs; a paragraph longer than cap is a chunk of its own. A page's figures go with its first unit.
    Equal page numbers are ordered by text, and units of equal rows lie side by side. Null doc_ids make one document. No
    pages: no chunks.

    Texts move once, to lie in order; then a chunk is let go of as soon as it is full, so that a task holds one of them,
    however long a document is.
    """
    target = to_arrow_schema(StructType.fromDDL(CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: object = run  # no document yet
        number = size = 0
        parts: list[str] = []
        first = last = None
        figures: list[str] = []
        out: list[dict] = []

        def close() -> None:
            if parts:
                text = "\n\n".join(parts)
                out.append({"doc_id": doc, "chunk": number, "page_start": first, "page_end": last, "n_chars": len(text), "text": text, "figures": list(figures)})

        for batch in slices(batches):
            for row in batch.to_pylist():
                new_doc = row["doc_id"] != doc
                if new_doc or row["fresh"] or size + 2 + len(row["text"]) > cap:
                    close()
                    number = 1 if new_doc else number + 1
                    doc, first, size = row["doc_id"], row["page"], -2
                    parts, figures = [], []
                parts.append(row["text"])
                size += 2 + len(row["text"])
                last = row["page"]
                figures += row["figures"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    units = page_units(pages, cap).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("long").alias("page"), "tie", "unit", "text", "fresh", "figures")
    return units.repartition("doc_id").sortWithinPartitions("doc_id", "page", "tie", "unit").mapInArrow(run, CHUNK)


def batch_states(costs: np.ndarray, before: list[float], most: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """For each number of open items on entry (columns 0 to most): items open after each item, and batches begun so far.

    before: costs of the items that precede, the last one last; a column that needs more of them than there are is not used.
    """
    n = len(costs)
    opened, begun = np.zeros((n, most + 1), np.int64), np.zeros((n, most + 1), np.int64)
    for e in range(min(most, len(before)) + 1):
        count, total, number = e, sum(before[len(before) - e :]), 0
        for k, cost in enumerate(costs.tolist()):
            if not count or count >= most or total + cost > limit:
                count, total, number = 0, 0.0, number + 1
            count, total = count + 1, total + cost
            opened[k, e], begun[k, e] = count, number
    return opened, begun


def cost_batches(items: DataFrame, most: int = 3, limit: float = 6500.0) -> DataFrame:
    """source, position, cost, batch (from 1 in each source): items in order, in batches of at most `most` items and `limit` cost.

    items: source, position, cost; an item that costs more than limit is a batch of its own. A null source is one source, a
    null cost counts as 0, and equal positions are ordered by cost. No items: no batches.

    A source may hold any share of the rows: items are sorted by ranges, and a range's outcome is worked out for each
    number of items that the open batch may hold when it begins (there are most + 1). The driver sees the ends of ranges
    whose source goes on in the next one, and tells the true entry of each.
    """
    spark = items.sparkSession
    rows = items.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"), "position", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    keys = ["src", "position", "cost", "met"]
    ordered = rows.withColumn("met", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("met")
    kept = written(ordered.withColumn("row", F.monotonically_increasing_id()), "batches").withColumn("part", F.shiftright("row", 33))
    # Only sources that reach over several ranges, at most one for each boundary, have anything to hand on.
    over = F.broadcast(kept.groupBy("src").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("src"))
    # Their last items in each range: all that the next range may need.
    tail = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("row", "cost")))), 1, most)
    back = kept.join(over, "src", "left_semi").withColumn("left", F.max("row").over(Window.partitionBy("part", "src")) - F.col("row")).where(F.col("left") < most)
    tails = {(r.part, r.src): [x.cost for x in reversed(r.tail)] for r in back.groupBy("part", "src").agg(tail.alias("tail")).collect()}
    before, known = {}, {}
    for part, src in sorted(tails):
        before[part, src] = known.get(src, [])
        known[src] = (known.get(src, []) + tails[part, src])[-most:]
    sent = spark.sparkContext.broadcast(before)

    def outcomes(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        opened, begun = batch_states(frame["cost"].to_numpy(), sent.value.get(key, []), most, limit)
        return frame.assign(opened=opened.tolist(), begun=begun.tolist())

    schema = "src string, position long, cost double, row long, part long, opened array<long>, begun array<long>"
    worked = written(kept.groupBy("part", "src").applyInPandas(outcomes, schema), "batch-states")
    ends = worked.join(over, "src", "left_semi").groupBy("part", "src").agg(F.max_by(F.struct("opened", "begun"), "row").alias("end")).collect()
    state, total, entries = {}, {}, []
    for r in sorted(ends, key=lambda r: (r.part, r.src)):
        e = state.get(r.src, 0)
        entries.append((r.part, r.src, e, total.get(r.src, 0)))
        state[r.src], total[r.src] = r.end.opened[e], total.get(r.src, 0) + r.end.begun[e]
    entry = spark.createDataFrame(entries, "part long, src string, entry int, base long")
    small = F.broadcast(entry) if len(entries) <= 100_000 else entry
    out = worked.join(small, ["part", "src"], "left").withColumns({"entry": F.coalesce("entry", F.lit(0)), "base": F.coalesce("base", F.lit(0))})
    return out.select(F.expr("substr(nullif(src, ''), 2)").alias("source"), "position", "cost", (F.col("base") + F.element_at("begun", F.col("entry") + 1)).alias("batch"))
