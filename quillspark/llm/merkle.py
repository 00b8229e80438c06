"""Merkle manifest of a data set: built levels are stored as parent-linked node rows, and a recursive query climbs them from each leaf.

A leaf is H of doc_id, source, lang, n_chars and text, where H is the sha256 of its inputs, concatenated, and digests count
as lower-case hex text. The leaves of a lang, ascending by doc_id, make a tree: while several nodes remain, each run of
FAN consecutive ones becomes its H. The trees' roots, ordered by lang (null first, then by UTF-8 bytes), make one more tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written

FAN = 8
#: Key of the tree over the roots. The trees of langs have the key "" (null) or "=" and the lang.
TOP = "^"
#: Node rows of upper levels that are broadcast at most; all levels below are joined by a shuffle.
BROADCAST_NODES = 50_000
#: Runs that one task folds at least, so that upper levels are not dealt over more tasks than they have work for.
RUNS_A_TASK = 4_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(text: Column) -> Column:
    """sha256 in 32 bytes; as an input of another digest it is written in hex."""
    return F.unhex(F.sha2(text, 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return h(F.concat(*map(field, (doc_id, source, lang, n_chars, text))))


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf and `altered`, the leaf after tampering, or null where there is none.

    Tampering lower-cases A-Z in the texts of documents whose crc32 of the decimal doc_id divides by 3; a null doc_id or
    text is left alone.
    """
    doc_id, text = F.col("doc_id"), F.col("text").cast("string")
    fields = [doc_id, F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars")]
    tampered = F.crc32(doc_id.cast("string")) % 3 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), doc_id.cast("long").alias("doc_id"),
        leaf_hash(*fields, text).alias("leaf"), F.when(tampered, leaf_hash(*fields, F.translate(text, _UPPER, _LOWER))).alias("altered"),
    )


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (tree, ...) with `row` (a number of its own for each), `pos` (its place in its tree, from 0) and `width` (rows of its tree).

    Rows are sorted by ranges and written; places are prefix sums of the counts by tree and range, so no tree, however
    large, comes together. Equal rows are told apart by where they were read.
    """
    keys = ["tree", *order, "met"]
    sorted_rows = rows.withColumn("met", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = written(sorted_rows.drop("met").withColumn("row", F.monotonically_increasing_id()), name)
    part = F.shiftright("row", 33).alias("part")
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = kept.groupBy("tree", part).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # A row for each tree and range that it reaches into.
    bases = written(bases.select("tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("tree")).alias("width")), f"{name}-bases")
    small = F.broadcast(bases) if bases.count() <= 100_000 else bases
    return kept.withColumn("part", part).join(small, ["tree", "part"]).withColumn("pos", F.col("base") + F.col("row") - F.col("first")).drop("part", "first", "base")


def levels_above(bottom: DataFrame, name: str) -> list[DataFrame]:
    """Node rows of each level over bottom (tree, pos, width, hash): tree, level, pos, width, hash and run, the children's hashes."""
    found: list[DataFrame] = []
    widest, size = bottom.agg(F.max("width"), F.count("*")).first()
    widest, below = widest or 1, bottom
    while widest > 1:
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: F.hex(x["hash"])), "")
        parents = below.where("width > 1").groupBy("tree", F.expr(f"pos DIV {FAN}").alias("up")).agg(F.unhex(run).alias("run"), F.max("width").alias("of"))
        below = written(parents.select("tree", F.lit(len(found) + 1).alias("level"), F.col("up").alias("pos"), F.ceil(F.col("of") / FAN).alias("width"), h(as_hex(F.col("run"))).alias("hash"), "run").coalesce(1 + size // (FAN * RUNS_A_TASK)), f"{name}-level")
        found.append(below)
        size = below.count()
        widest = -(-widest // FAN)
    return found


def linked(nodes: DataFrame, level: int, ranks: DataFrame | None) -> DataFrame:
    """nodes with up_tree, up_level, up_pos (the parent's key, null for the root), slot (the place among its children) and is_top (root of its tree)."""
    inner = nodes.where("width > 1").select("*", F.col("tree").alias("up_tree"), F.lit(level + 1).alias("up_level"), F.expr(f"pos DIV {FAN}").alias("up_pos"), (F.col("pos") % FAN).cast("int").alias("slot"), F.lit(False).alias("is_top"))
    tops = nodes.where("width = 1")
    if ranks is None:
        return inner.unionByName(tops.select("*", F.lit(None).cast("string").alias("up_tree"), F.lit(0).alias("up_level"), F.lit(0).cast("long").alias("up_pos"), F.lit(0).alias("slot"), F.lit(False).alias("is_top")))
    up = ranks.where("width > 1").select("tree", F.lit(TOP).alias("up_tree"), F.lit(1).alias("up_level"), F.expr(f"pos DIV {FAN}").alias("up_pos"), (F.col("pos") % FAN).cast("int").alias("slot"))
    return inner.unionByName(tops.join(up, "tree", "left").withColumn("is_top", F.lit(True)))


CLIMB = """
WITH RECURSIVE climb(row, doc_id, leaf, step, folded, siblings, subroot, up_tree, up_level, up_pos, slot) AS (
  SELECT row, doc_id, leaf, step, folded, siblings, subroot, up_tree, up_level, up_pos, slot FROM {start}
  UNION ALL
  SELECT {hint} c.row, CAST(NULL AS BIGINT), CAST(NULL AS BINARY), c.step + 1,
    unhex(sha2(lower(hex(concat(substr(n.run, 1, 32 * c.slot), c.folded, substr(n.run, 32 * c.slot + 33)))), 256)),
    concat(substr(n.run, 1, 32 * c.slot), substr(n.run, 32 * c.slot + 33)),
    CASE WHEN n.is_top THEN n.hash END, n.up_tree, n.up_level, n.up_pos, n.slot
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos
) SELECT * FROM climb"""


def climb(start: DataFrame, nodes: DataFrame, broadcast: bool) -> DataFrame:
    """A row for each leaf and step: the hash folded so far and the siblings met in this step.

    The recursion's limit on rows is lifted for the session: it climbs as many rows as there are leaves.
    """
    start.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return start.sparkSession.sql(CLIMB.replace("{hint}", "/*+ BROADCAST(n) */" if broadcast else ""), start=start, nodes=nodes)


def manifest(docs: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Each document's leaf, its tree's root, the root, its proof and what the proof makes of the tampered leaf.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored. Result: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified; digests in hex. Nulls are fields of their own ("-"), a null lang is a tree of its
    own. Repeated doc_ids stay, null ones come first; both are ordered by their leaf's hash. One leaf alone is its tree's
    root and the root, and its proof is H of nothing. No documents: no rows.

    Levels are tables; the climb is one row a leaf, joined with one node row a step. Levels of few nodes are broadcast,
    after they are counted, since all leaves meet there; below that the join shuffles by node, of at most FAN ** level leaves.
    """
    leaves = ranked(leaves_of(docs), ["doc_id", "leaf"], "merkle-leaves")
    bottom = leaves.withColumnRenamed("leaf", "hash")
    levels = levels_above(bottom.select("tree", "pos", "width", "hash"), "merkle")
    tops = reduce(DataFrame.unionByName, [x.where("width = 1").select("tree", "hash") for x in (bottom, *levels)])
    ranks = ranked(tops.withColumnsRenamed({"tree": "of"}).withColumn("tree", F.lit(TOP)), ["of"], "merkle-tops")
    upper = levels_above(ranks.select("tree", "pos", "width", "hash"), "merkle-top")
    by_tree = ranks.select(F.col("of").alias("tree"), "pos", "width")
    nodes = [linked(x, k, by_tree) for k, x in enumerate(levels, 1)] + [linked(x, k, None) for k, x in enumerate(upper, 1)]
    start = linked(leaves, 0, by_tree).select(
        "row", "doc_id", "leaf", F.lit(0).alias("step"), F.coalesce("altered", "leaf").alias("folded"), F.lit(b"").alias("siblings"),
        F.when(F.col("is_top"), F.col("leaf")).alias("subroot"), "up_tree", "up_level", "up_pos", "slot",
    )
    if not nodes:
        steps = start
    else:
        counts = [x.count() for x in (*levels, *upper)]
        all_nodes = written(reduce(DataFrame.unionByName, nodes), "merkle-nodes")
        cut = next(k for k in range(len(levels) + 1) if sum(counts[k:]) <= broadcast_nodes or k == len(levels))
        small = sum(counts[cut:]) <= broadcast_nodes
        high = (F.col("up_tree") == TOP) | (F.col("up_level") > cut)
        if cut:
            low = written(climb(start, all_nodes.where((F.col("tree") != TOP) & (F.col("level") <= cut)), False), "merkle-climb")
            stopped = F.coalesce(high, F.lit(False))
            rest = climb(low.where(stopped), all_nodes.where((F.col("tree") == TOP) | (F.col("level") > cut)), small)
            steps = low.where(~stopped).unionByName(rest)
        else:
            steps = climb(start, all_nodes, small)
    last = upper[-1].where("width = 1") if upper else ranks
    root = last.select("hash").first()  # one row: the root
    proof = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "siblings"))), lambda x: as_hex(x["siblings"])), "")
    folded = steps.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"), F.max("subroot").alias("subroot"),
        F.sha2(proof, 256).alias("proof_sha256"), F.max_by("folded", "step").alias("end"),
    )
    root_hash = F.lit(bytes(root[0]) if root else None).cast("binary")
    return folded.select("doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), as_hex(root_hash).alias("root"), "proof_sha256", as_hex(F.col("end")).alias("folded_root"), (F.col("end") == root_hash).alias("verified"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; see `manifest` for nulls, ties, repeated rows and empty tables."""
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle(levels: int = 8, top_levels: int = 2) -> str:
    """The same by joins that are written out, for trees of at most FAN ** levels leaves and FAN ** top_levels langs.

    A tree of one node passes it up unchanged, so every tree has its root on the highest level.
    """

    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    def tower(name: str, count: int) -> list[str]:
        return [
            f"{name}{k} AS (SELECT tree, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN max(hash) ELSE sha256(string_agg(hash, '' ORDER BY pos)) END AS hash, CASE WHEN max(n) = 1 THEN NULL ELSE string_agg(hash, '' ORDER BY pos) END AS run FROM {name}{k - 1} GROUP BY tree, pos // 8)"
            for k in range(1, count + 1)
        ]

    def step(k: int, before: str, nodes: str, tree: str, at: str, power: int) -> str:
        own = f"(x.{at} // {power}) % 8 * 64"
        return f"c{k} AS (SELECT x.* EXCLUDE (folded, proof), CASE WHEN n.run IS NULL THEN folded ELSE sha256(substr(n.run, 1, {own}) || folded || substr(n.run, {own} + 65)) END AS folded, CASE WHEN n.run IS NULL THEN proof ELSE proof || substr(n.run, 1, {own}) || substr(n.run, {own} + 65) END AS proof FROM {before} x JOIN {nodes} n ON n.tree = x.{tree} AND n.pos = x.{at} // {power * 8})"

    digits = "CAST(doc_id AS VARCHAR)"
    bits = f"list_transform(range(0, strlen({digits}) * 8), lambda i: (ascii(substr({digits}, CAST(i // 8 + 1 AS INT), 1)) >> CAST(i % 8 AS INT)) & 1)"
    crc = f"list_reduce({bits}, lambda c, b: xor(c >> 1, ((c & 1) + b) % 2 * 3988292384), 4294967295)"
    parts = [
        "docs AS (SELECT *, coalesce('=' || lang, '') AS tree FROM documents)",
        f"hashed AS (SELECT doc_id, tree, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf('''translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')''')} END AS altered FROM docs)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed)",
        "l0 AS (SELECT tree, pos, n, leaf AS hash FROM leaves)",
        *tower("l", levels),
        f"t0 AS (SELECT '^' AS tree, tree AS lang_tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, hash FROM l{levels})",
        *tower("t", top_levels),
        "c0 AS (SELECT v.doc_id, v.leaf, v.tree, v.pos, t0.pos AS lang_pos, t0.hash AS subroot, '^' AS top, coalesce(altered, leaf) AS folded, '' AS proof FROM leaves v JOIN t0 ON t0.lang_tree = v.tree)",
    ]
    parts += [step(k, f"c{k - 1}", f"l{k}", "tree", "pos", 8 ** (k - 1)) for k in range(1, levels + 1)]
    parts += [step(levels + k, f"c{levels + k - 1}", f"t{k}", "top", "lang_pos", 8 ** (k - 1)) for k in range(1, top_levels + 1)]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.hash AS verified FROM c{levels + top_levels}, (SELECT hash FROM t{top_levels}) root"


OP13_SQL = _oracle()
