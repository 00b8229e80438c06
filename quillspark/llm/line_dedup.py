"""Line de-duplication by a deletion-neighbourhood join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import free_shuffles, written

SPACES = r"[\x20\x09-\x0D]+"


def line_words(line: Column) -> Column:
    return F.filter(F.split(line, SPACES), lambda w: w != "")


def half_keys(n: Column, words: Column) -> Column:
    """Hashes of the first and the last half, as a line of n words and as one of n - 1 words.

    Lines of equal length that differ in one word share one of their halves; a line that has one
    word more than another shares a half with it in the second way.
    """
    key = lambda kind, size, part: F.xxhash64(F.lit(kind), size, part)
    keys = []
    for size in (n, n - 1):
        front = F.floor(size / 2).cast("int")
        keys += [key(0, size, F.slice(words, F.lit(1), front)), key(1, size, F.slice(words, n - (size - front) + 1, size - front))]
    return F.array(*keys)


def sized(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """Broadcast for a counted table of at most `most` rows of a few numbers; beyond, joins shuffle."""
    return F.broadcast(df) if rows <= most else df


def hashed_lines(docs: DataFrame, min_words: int, exact_from: int) -> DataFrame:
    """doc_id, line_no (from 0), line (128 bits of hash), halves, for lines of exact_from words and more.

    Lines under min_words words have no halves, so they meet equal lines only.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("line_no", "line"))
    worded = lines.select("doc_id", "line_no", line_words(F.col("line")).alias("words")).withColumn("n", F.size("words")).where(F.col("n") >= exact_from)
    halves = F.when(F.col("n") >= min_words, half_keys(F.col("n"), F.col("words"))).otherwise(F.array().cast("array<bigint>"))
    return worded.select("doc_id", "line_no", F.struct(F.xxhash64("words").alias("a"), F.xxhash64(F.lit(7), F.lit("line"), "words").alias("b")).alias("line"), halves.alias("halves"))


def variants(texts: DataFrame) -> DataFrame:
    """key, id, n, k for texts (id, words): the hash of the line without word k (from 0), and that of the whole line with k = n.

    The hash of a line is the XOR of its words' hashes with their places. Without word k it joins those of the words before
    k with those of the words after it, each one place earlier; both come from running XORs along the line.
    """
    placed = texts.repartition("id").select("id", F.size("words").alias("n"), F.posexplode("words").alias("k", "word"))
    hashed = placed.select("id", "n", "k", F.xxhash64("word", "k").alias("here"), F.xxhash64("word", F.col("k") - 1).alias("earlier"))
    along = Window.partitionBy("id").orderBy("k")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("id")
    less = hashed.select("id", "n", "k", (F.coalesce(F.bit_xor("here").over(before), F.lit(0)).bitwiseXOR(F.bit_xor("earlier").over(whole)).bitwiseXOR(F.bit_xor("earlier").over(after))).alias("key"), F.bit_xor("here").over(whole).alias("total"))
    each = F.when(F.col("k") == 0, F.array(F.struct("key", "k"), F.struct(F.col("total").alias("key"), F.col("n").alias("k")))).otherwise(F.array(F.struct("key", "k")))
    return less.select("id", "n", F.explode(each).alias("v")).select("v.key", "id", "n", "v.k")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Lines within one word edit (replaced, left out, put in) of an earlier different line: column line.

    distinct: line, first (struct doc_id, line_no), halves. Only lines that share a half with another line can
    be within the bound, so only they emit variants. Equal variants are joined with the earliest line of
    theirs, never with each other in pairs.
    """
    keys = distinct.select("line", F.explode("halves").alias("half"))
    differ = "least_a <> most_a OR least_b <> most_b"
    shared = keys.groupBy("half").agg(F.min("line.a").alias("least_a"), F.max("line.a").alias("most_a"), F.min("line.b").alias("least_b"), F.max("line.b").alias("most_b")).where(differ).select("half")
    shared = written(shared, "shared-halves")
    close = keys.join(sized(shared, shared.count()), "half", "left_semi").select("line").distinct()
    # Numbers that ascend as the lines' first places do, so that one number tells both the line and which is earlier.
    places = distinct.join(close, "line").select("line", F.col("first.doc_id").alias("of"), F.col("first.line_no").alias("at"))
    places = written(places.orderBy("of", "at").withColumn("id", F.monotonically_increasing_id()), "close-lines")
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = taken.join(sized(places, places.count(), 300_000), F.col("doc_id") == F.col("of")).select("id", "line", line_words(F.get(F.split("text", "\n"), F.col("at"))).alias("words"))
    # Rows with equal doc_ids may differ: the hash tells which of them has the line.
    texts = texts.where((F.xxhash64("words") == F.col("line.a")) & (F.xxhash64(F.lit(7), F.lit("line"), "words") == F.col("line.b"))).dropDuplicates(["id"])
    texts = written(texts, "close-words")
    spread = written(variants(texts.select("id", "words")), "variants")
    one_less, whole = spread.where("k < n"), spread.where("k = n").select("key", F.col("id").alias("other"), F.col("n").alias("other_n"))
    # Replaced: the same word left out of lines of equal length. The earliest line of each group stands for it.
    groups = written(one_less.groupBy("key", "n", "k").agg(F.min("id").alias("earlier"), F.max("id").alias("latest")).where("earlier <> latest").drop("latest"), "equal-variants")
    replaced = one_less.join(sized(groups, groups.count()), ["key", "n", "k"]).where("id > earlier").select(F.col("id").alias("later"), "earlier", "k", F.lit("replaced").alias("how"))
    # Left out or put in: a line without word k is another whole line.
    longer = one_less.join(sized(whole, texts.count()), "key").where("n = other_n + 1").select(F.greatest("id", "other").alias("later"), F.least("id", "other").alias("earlier"), "k", F.when(F.col("id") > F.col("other"), "longer").otherwise("shorter").alias("how"))
    pairs = replaced.unionByName(longer)
    # Verified on the words themselves.
    a = texts.select(F.col("id").alias("later"), F.col("line"), F.col("words").alias("x"))
    b = texts.select(F.col("id").alias("earlier"), F.col("words").alias("y"))
    cut = lambda c: F.concat(F.slice(c, F.lit(1), F.col("k")), F.slice(c, F.col("k") + 2, F.greatest(F.size(c) - F.col("k") - 1, F.lit(0))))
    same = F.when(F.col("how") == "replaced", (F.size("x") == F.size("y")) & (cut(F.col("x")) == cut(F.col("y")))).when(F.col("how") == "longer", cut(F.col("x")) == F.col("y")).otherwise(cut(F.col("y")) == F.col("x"))
    return pairs.join(a, "later").join(b, "earlier").where(same).select("line").distinct()


def repeated_lines(docs: DataFrame, min_words: int, exact_from: int) -> DataFrame:
    """of, dropped: the line numbers of each document that repeat an earlier line, or nearly so."""
    lines = written(hashed_lines(docs, min_words, exact_from), "lines")
    distinct = written(lines.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves")), "distinct-lines")
    near = written(near_lines(docs, distinct), "near-lines")
    free_shuffles(docs.sparkSession)
    marked = distinct.select("line", "first", "copies").join(near.withColumn("near", F.lit(True)), "line", "left").where("copies > 1 OR near").select("line", "first", F.coalesce("near", F.lit(False)).alias("near"))
    marked = written(marked, "marked-lines")
    hit = lines.select("doc_id", "line_no", "line").join(sized(marked, marked.count(), 500_000), "line").where(F.col("near") | (F.struct("doc_id", "line_no") > F.col("first")))
    return written(hit.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("line_no").alias("dropped")), "dropped-lines")


def dedup_lines(docs: DataFrame, min_words: int = 8, exact_from: int | None = None) -> DataFrame:
    """docs (doc_id, text; other columns stay) with n_lines, n_dropped, and text without repeated lines.

    Lines end at \\n. A line of exact_from words and more (min_words if None) is dropped if an earlier line, by
    (doc_id, place), has the same words; one of min_words words and more also if an earlier line of min_words words
    and more is within one word edit. The earliest stays. Edits need a length because a word is much of a short
    line: any two lines of one word are one edit apart, as are numbered headings. Lines without words part
    paragraphs and always stay. Null and empty texts stay as they are, with one empty line. Rows with
    equal doc_ids are taken for one document, so what repeats between them at equal places stays; a document without doc_id
    stays whole. Columns named n_lines or n_dropped are replaced. No documents: no rows.
    """
    gone = repeated_lines(docs.select("doc_id", "text"), min_words, min_words if exact_from is None else exact_from)
    gone = gone.select(F.col("of").alias("__of"), F.col("dropped").alias("__dropped"))
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    joined = docs.join(sized(gone, gone.count(), 300_000), F.col("doc_id").cast("long") == F.col("__of"), "left")
    kept = F.filter(lines, lambda line, k: ~F.array_contains("__dropped", k))
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counted = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("__dropped"), F.lit(0)).cast("long"), "text": text}
    return joined.withColumns(counted).drop("__of", "__dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), exact_from=1)


OP8_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, text FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(l))) AS k, unnest(l) AS s FROM cut),
worded AS (SELECT doc_id, k, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM lines),
every AS (SELECT w, min((doc_id, k)) AS f FROM worded WHERE len(w) >= 1 GROUP BY w),
firsts AS (SELECT * FROM every WHERE len(w) >= 8),
less AS (SELECT w, f, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS v, len(w) AS n FROM (SELECT w, f, unnest(range(1, len(w) + 1)) AS i FROM firsts)),
near AS (
  SELECT a.w FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.n = b.n WHERE b.f < a.f
  UNION SELECT a.w FROM less a JOIN firsts b ON a.v = array_to_string(b.w, ' ') AND a.n = len(b.w) + 1 WHERE b.f < a.f
  UNION SELECT b.w FROM less a JOIN firsts b ON a.v = array_to_string(b.w, ' ') AND a.n = len(b.w) + 1 WHERE a.f < b.f
),
gone AS (SELECT doc_id, list(k) AS ks FROM worded JOIN every USING (w) WHERE (doc_id, k) > f OR w IN (SELECT w FROM near) GROUP BY doc_id)
SELECT cut.doc_id, CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_filter(l, lambda s, i: NOT list_contains(ks, i - 1)), chr(10)) END AS text,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_dropped
FROM cut LEFT JOIN gone USING (doc_id)
"""
