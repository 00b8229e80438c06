"""Packing of token sequences by column generation for the cutting-stock problem."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, text_slices, tidy, written
from quillspark.llm.tokens import shared_encoder, tokenizer_path

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, capacity: int, unit: int, end_id: int, tokenizer: str) -> DataFrame:
    """Cuts each document's ids into full pieces of `capacity` and a rest.

    `units` is a piece's length in units, rounded up; `part` and `place` number the pieces of
    equal units within the task that made them.
    """
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity // unit + 1, np.int64)
        for batch in text_slices(batches, "text", 2_000_000):
            ids, ends = encoder.encode(batch["text"])
            ids = np.insert(ids, ends[1:], end_id).astype("<u4")
            ends = ends + np.arange(len(ends))
            tokens = np.diff(ends)
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, tokens[doc] - start)
            units = -(-length // unit)
            order = np.argsort(units, kind="stable")
            counts = np.bincount(units, minlength=len(seen))
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            begin = ends[doc] + start
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"].take(pa.array(doc)), "start": start, "length": length,
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begin, begin + length, strict=True)], pa.int64()),
                "doc_tokens": tokens[doc], "units": units, "part": np.full(len(doc), part), "place": place,
            })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(texts.mapInArrow(tidy(cut), f"{_PIECE}, units long, part long, place long"), "pieces")


def _best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of the largest value."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.searchsorted(sizes, c, side="right")
        if fits:
            got = best[c - sizes[:fits]] + values[:fits]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], last[c] = got[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), pattern


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts by size) and how often each is used; together they cover the demand.

    The linear program starts from patterns of one size and takes in the pattern that the
    knapsack prices best, until Farley's bound shows a gap of at most `gap`. Its solution is
    rounded down, and what then is left goes best-fit into further patterns.
    sizes ascend; the work depends on their number only.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(60 * n):
        amounts = np.linalg.solve(basis, demand.astype(float))
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, pattern = _best_pattern(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + gap:
            break
        step = np.linalg.solve(basis, pattern)
        ratios = np.full(n, np.inf)
        np.divide(amounts, step, out=ratios, where=step > 1e-9)
        basis[:, int(np.argmin(ratios))] = pattern
    used = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-9).astype(np.int64)
    patterns = basis.T.round().astype(np.int64)
    # A pattern may hold more of a size than is wanted; those places stay free for other sizes.
    left = np.maximum(demand - used @ patterns, 0)
    rest: list[np.ndarray] = []
    room: list[int] = []
    for k in range(n - 1, -1, -1):
        for _ in range(int(left[k])):
            fit = min((j for j, r in enumerate(room) if r >= sizes[k]), key=lambda j: room[j], default=-1)
            if fit < 0:
                rest.append(np.zeros(n, np.int64))
                room.append(capacity)
                fit = len(rest) - 1
            rest[fit][k] += 1
            room[fit] -= sizes[k]
    patterns = np.vstack([patterns[used > 0], *[x[None] for x in rest]])
    return patterns, np.concatenate([used[used > 0], np.ones(len(rest), np.int64)])


def pack(docs: DataFrame, capacity: int = 2048, unit: int = 16, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Places all ids of docs (doc_id, text) in sequences of at most `capacity`.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. The histogram of lengths in units (capacity / unit bins at most) is all that comes to the
    driver. Pieces of equal units are ranked by prefix sums over tasks; a rank selects a place of a
    pattern by arithmetic. Null texts are empty and hold the end id alone; equal rows are packed
    each; no documents give no rows; other columns are ignored.
    """
    if capacity % unit:
        raise ValueError("capacity must be a multiple of unit")
    pieces = token_pieces(docs, capacity, unit, end_id, tokenizer or tokenizer_path())
    by_part = pieces.groupBy("units", "part").agg(F.count("*").alias("n"))
    ranks = by_part.select("units", "part", (F.sum("n").over(Window.partitionBy("units").orderBy("part")) - F.col("n")).alias("before"))
    histogram = sorted((r.units, r.n) for r in by_part.groupBy("units").agg(F.sum("n").alias("n")).collect())
    if not histogram:
        return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    sizes, demand = (np.array(x, np.int64) for x in zip(*histogram, strict=True))
    patterns, used = cutting_patterns(sizes, demand, capacity // unit)
    first_sequence = np.cumsum(used) - used
    #: For each size: the patterns with it, and the rank at which each pattern's places begin.
    places = {}
    for k, size in enumerate(sizes):
        with_it = np.flatnonzero(patterns[:, k])
        places[int(size)] = (with_it, np.cumsum(patterns[with_it, k] * used[with_it]) - patterns[with_it, k] * used[with_it])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rank = batch["units"].to_numpy(), batch["rank"].to_numpy()
            sequence = np.zeros(len(rank), np.int64)
            for size in np.unique(units):
                rows = np.flatnonzero(units == size)
                with_it, begins = places[int(size)]
                at = np.searchsorted(begins, rank[rows], side="right") - 1
                sequence[rows] = first_sequence[with_it[at]] + (rank[rows] - begins[at]) % used[with_it[at]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])

    ranked = pieces.join(ranks, ["units", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")
    placed = ranked.mapInArrow(place, f"{_PIECE}, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    return placed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
