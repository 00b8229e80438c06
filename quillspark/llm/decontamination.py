"""Benchmark decontamination over a positional inverted index, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written

#: What separates words: ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """Words of a text in their order; A-Z count as a-z; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER), SEPARATORS), lambda w: w != "")


def count_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def sized_broadcast(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Broadcast for a counted table of at most `most` short rows; beyond, Spark joins by shuffling."""
    return F.broadcast(df) if rows <= most else df


def test_items(benchmark: DataFrame) -> DataFrame:
    """key, item_id and its words, for items that have any; equal rows once.

    Rows of one item_id, or of none, may differ in their texts: the key (128 bits of hash) tells them apart.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words().alias("item_words")).where(F.size("item_words") > 0).distinct()
    half = lambda seed: F.hex(F.xxhash64(F.lit(seed), F.col("item_id").isNull(), "item_id", "item_words"))
    return items.select(F.concat(half(0), F.lit("-"), half(1)).alias("key"), "item_id", "item_words")


def anchors(items: DataFrame, counts: DataFrame, width: int, rarest: int) -> DataFrame:
    """The rarest terms of each window: key (of the text), first (of the window), term, at (its place in the item).

    A term that the documents lack has no postings, so its windows can't occur and are left out.
    """
    spread = items.select("key", F.size("item_words").alias("n"), F.posexplode("item_words").alias("at", "term")).join(counts, "term", "left")
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.least(F.col("at"), F.greatest(F.lit(0), F.col("n") - width)))
    inside = spread.withColumn("first", F.explode(starts))
    rank = Window.partitionBy("key", "first").orderBy(F.col("hits").asc_nulls_first(), "at")
    best = inside.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= rarest)
    alive = best.groupBy("key", "first").agg(F.count("hits").alias("known"), F.count("*").alias("of")).where("known = of")
    return best.join(alive, ["key", "first"]).select("key", "first", "term", "at")


def term_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """How often each benchmark term occurs in all documents."""
    terms = items.select(F.explode("item_words").alias("term")).distinct()
    n = terms.count()
    return docs.select(F.explode(words()).alias("term")).join(sized_broadcast(terms, n), "term").groupBy("term").agg(F.count("*").alias("hits"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of the given terms: term, doc_id, pos."""
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(words()).alias("pos", "term"))
    return spread.join(sized_broadcast(terms, terms.count()), "term").select("term", "doc_id", "pos")


def alignments(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Where a window may lie: doc_id, key, shift (place in the document less place in the item).

    The rarest terms' posting lists, less the terms' places, meet on equal documents and shifts;
    a shift stays if all rarest terms of one window are there.
    """
    places = chosen.select("key", "term", "at").distinct()
    found = index.join(sized_broadcast(places, places.count()), "term").groupBy("doc_id", "key", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("there"))
    needed = chosen.groupBy("key", "first").agg(F.array_sort(F.collect_set("at")).alias("need")).groupBy("key").agg(F.collect_set("need").alias("needs"))
    both = found.join(needed, "key")
    return both.where(F.exists("needs", lambda need: F.size(F.array_except(need, F.col("there"))) == 0)).select("doc_id", "key", "shift")


def exact_hits(docs: DataFrame, items: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """Verified windows: doc_id, item_id, and the document's places inside any of them.

    Documents are joined by doc_id, so rows with equal doc_ids are compared each.
    """
    joined = places.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id").withColumn("doc_words", words()).join(items, "key")
    n, size = F.size("item_words"), F.least(F.lit(width), F.size("item_words"))
    # get() gives null outside the document.
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(F.when(F.col("shift") + k >= 0, F.get("doc_words", (F.col("shift") + k).cast("int"))) == F.get("item_words", k.cast("int")), F.lit(False)))
    # The length of the run of equal words that ends at each place, and then the places of runs of a window's length.
    runs = F.aggregate("same", F.expr("array(0)"), lambda got, x: F.concat(got, F.array(F.when(x, F.element_at(got, -1) + 1).otherwise(F.lit(0)))))
    ends = F.filter(F.transform("runs", lambda r, k: F.when(r >= F.col("size"), k - 1)), lambda k: k.isNotNull())
    hits = F.array_distinct(F.flatten(F.transform("ends", lambda e: F.sequence(F.col("shift") + e - F.col("size") + 1, F.col("shift") + e))))
    out = joined.withColumn("size", size).withColumn("same", same).withColumn("runs", runs).withColumn("ends", ends).where(F.size("ends") > 0)
    return out.select("doc_id", "item_id", hits.alias("hits"))


def proximity(docs: DataFrame, benchmark: DataFrame, span: int = 26, width: int = 13, rarest: int = 3) -> DataFrame:
    """Where the `rarest` terms of a window stand within `span` words, in any order: doc_id, item_id, first, pos; a row for each text of an item.

    pos is the place of the window's rarest term; terms meet it in the same or a neighbouring block of `span` places.
    Short items have fewer terms. A window with a term that no document has is left out.
    """
    items = test_items(benchmark)
    chosen = written(anchors(items, written(term_counts(docs, items), "term-counts"), width, rarest), "anchors")
    index = written(postings(docs, chosen.select("term").distinct()), "postings")
    numbered = chosen.withColumn("k", F.row_number().over(Window.partitionBy("key", "first").orderBy("at"))).withColumn("of", F.count("*").over(Window.partitionBy("key", "first")))
    lead = index.join(numbered.where("k = 1"), "term").select("doc_id", "key", "first", "of", "pos").withColumn("block", F.explode(F.array(*[F.floor(F.col("pos") / span) + d for d in (-1, 0, 1)])))
    other = index.join(numbered.where("k > 1"), "term").select("doc_id", "key", "first", "k", F.col("pos").alias("near"), F.floor(F.col("pos") / span).alias("block"))
    met = lead.join(other, ["doc_id", "key", "first", "block"]).where(F.abs(F.col("near") - F.col("pos")) < span)
    pairs = met.groupBy("doc_id", "key", "first", "pos", "of").agg(F.countDistinct("k").alias("met")).where("met = of - 1")
    alone = index.join(numbered.where("of = 1"), "term").select("doc_id", "key", "first", "pos")
    return pairs.select("doc_id", "key", "first", "pos").unionByName(alone).join(items.select("key", "item_id"), "key").select("doc_id", "item_id", "first", "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, rarest: int = 2, percent: int = 5) -> DataFrame:
    """For each row of docs (doc_id, text; others are ignored): n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `width` consecutive words of an item, or all of a shorter item; a document word in
    an occurrence is hit. Contaminated: hit words are `percent` of all words or more. Null and
    empty texts have no words and no hits; items without words are ignored; an empty benchmark
    hits nothing. Rows with equal doc_ids share the hits of all of them. Texts that share an item_id are each looked
    for and count as one item; those without an item_id hit words, but are no item in n_items and items_sha256.
    """
    items = written(test_items(benchmark), "items")
    chosen = written(anchors(items, written(term_counts(docs, items), "term-counts"), width, rarest), "anchors")
    index = written(postings(docs, chosen.select("term").distinct()), "postings")
    hits = written(exact_hits(docs, items, written(alignments(index, chosen), "alignments"), width), "hits")
    # An item's hits in a document are bounded by the document; documents hit often are summed place by place.
    n_hit = hits.select("doc_id", F.explode("hits").alias("place")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    found = hits.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.count("item_id").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_set("item_id"))).alias("found"))
    both = written(n_hit.join(found, "doc_id").select(F.col("doc_id").alias("hit_id"), "n_hit", "n_items", "found"), "hit-documents")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_words().alias("n_words"))
    joined = counted.join(both, F.col("doc_id") == F.col("hit_id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = joined.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("found", F.lit("")), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    bad = written(contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH cut AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark
), sizes AS (SELECT DISTINCT least(13, len(w)) AS k FROM cut WHERE kind = 1 AND len(w) > 0),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 11))) AS p FROM cut WHERE kind = 1 AND len(w) > 0)
), doc_windows AS (
  SELECT id AS doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM cut, sizes WHERE kind = 0 AND len(w) >= k)
), found AS (SELECT doc_id, item_id, p, k FROM doc_windows JOIN item_windows USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM cut LEFT JOIN hit ON hit.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE kind = 0
"""
