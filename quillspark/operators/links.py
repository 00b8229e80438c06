"""Joins on passages, bands and links."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ready_to_checkpoint(spark) -> None:
    """Uses the cluster's spark.checkpoint.dir; sets a folder only where there is none, as in tests."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))


def thinned(links: DataFrame) -> DataFrame:
    """a, b: fewer links with the same components as links (a, b) between different nodes.

    Both ends of a link are linked with the smallest neighbour of its larger end instead.
    So all pairs of a group of near copies become about as many links as there are copies.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    least = ends.groupBy("b").agg(F.min("a").alias("least"))
    met = ends.join(least, "b")
    return met.select(F.col("least").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the smallest node that links (a, b) reach. Labels spread by minima; lineage is cut by checkpoints."""
    ready_to_checkpoint(links.sparkSession)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("of"), F.col("component").alias("hop"))
        after = labels.join(near, "node").join(hop, F.col("component") == F.col("of"), "left").select("node", F.least("component", "near", "hop").alias("component"), F.col("component").alias("before")).checkpoint()
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def windows(texts: DataFrame, width: int) -> DataFrame:
    """id, passage (hash of width consecutive words, lower-case, of letters and digits), once for each place."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    cut = texts.select("id", words.alias("w")).where(F.size("w") >= width)
    return cut.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda k: F.xxhash64(F.slice("w", k, width)))).alias("passage"))


def passages(texts: DataFrame, width: int) -> DataFrame:
    """`windows`, distinct."""
    return windows(texts, width).distinct()


def reachable(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """All pairs (a, b) with a path from a to b; distances double in each round."""
    ready_to_checkpoint(edges.sparkSession)
    paths = edges.select("a", "b").distinct().checkpoint()
    for _ in range(rounds):
        longer = paths.join(paths.select(F.col("a").alias("m"), F.col("b").alias("c")), F.col("b") == F.col("m")).select("a", F.col("c").alias("b"))
        grown = paths.unionByName(longer).distinct().checkpoint()
        if grown.count() == paths.count():
            return grown
        paths = grown
    raise RuntimeError("paths did not settle")


#: Characters that a passage has at least, and of a gram: so it has at least GRAMS_OF_PASSAGE grams.
PASSAGE, GRAM = 60, 16
GRAMS_OF_PASSAGE = PASSAGE - GRAM + 1


def least_grams(text: str) -> np.ndarray:
    """The least hash of the grams of each passage of PASSAGE characters, distinct; none for a shorter text.

    What contains a passage has its least hash too, whatever stands around it and in whatever script.
    """
    if len(text) < PASSAGE:
        return np.zeros(0, np.int64)
    h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for step in (1, 2, 4, 8):
        h ^= h >> np.uint64(29)
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    for step in (1, 2, 4, 8, 16, GRAMS_OF_PASSAGE - 32):
        h = np.minimum(h[:-step], h[step:])
    return np.unique(h).view(np.int64)


def passage_keys(texts: DataFrame, first: bool = False) -> DataFrame:
    """id (a long), key: the hashes of least_grams of each text, or of its first passage only; texts that meet no key share no passage."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                found = [least_grams((t or "")[:PASSAGE] if first else t or "") for t in part["text"].to_pylist()]
                ids = np.repeat(part["id"].to_numpy(zero_copy_only=False), [len(x) for x in found])
                yield pa.record_batch({"id": pa.array(ids, pa.int64()), "key": pa.array(np.concatenate(found) if found else [], pa.int64())})

    return texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL").mapInArrow(keys, "id long, key long")
