"""Personal data: exact base spans, and candidates judged by boosted trees, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive where nothing that follows could match less: Java then loops where it would recurse. A match that
#: begins within a run of its first characters begins with the run too, unless the last match (\G) ended there; so a long run is walked once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider generators: they find most of what the base patterns find, and more. Spans may overlap.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"[0-9]{1,3}(\x20?[.,]\x20?[0-9]{1,3}){3}",
    "card": r"[0-9]{4}([\x20./_-]{0,2}[0-9]{4}){2}[\x20./_-]{0,2}[0-9]{4,7}",
    "phone": r"(\+|00)?[0-9]{1,3}[\x20./-]{0,2}(\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-]{1,2}[0-9]{3}[\x20./-]{0,2}[0-9]{3,4}",
}
#: Words before a span that speak of its kind.
CUES = {"email": r"(?i)(mail|write|contact)", "ip": r"(?i)(\bip\b|host|server|addr)", "card": r"(?i)(card|visa|pay|account)", "phone": r"(?i)(call|phone|tel|fax|mobile)"}


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: structs of start, end (code points, end exclusive) and value.

    The pieces between matches give the places: split and regexp_extract_all walk over the same matches.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("value"))
    none = F.expr(f"cast(array() as {SPANS})")

    def add(got: Column, x: Column) -> Column:
        start = got["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(got["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

    def spans(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), add)["out"]

    def in_parts(all_matches: Column) -> Column:
        """Arrays grow by copying, so many matches are taken in parts of 128, each from where it begins."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_matches) - 1) / 128).cast("int")), lambda k: F.slice(all_matches, k * 128 + 1, F.lit(128)))
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["value"])))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda got, n: F.array_append(got, F.element_at(got, -1) + n))
        return named(F.struct(parts.alias("parts"), begins.alias("begins")), lambda v: F.flatten(F.transform(v["parts"], lambda part, k: spans(F.get(v["begins"], k), part))))

    return named(both, lambda m: F.when(F.size(m) == 0, none).when(F.size(m) <= 128, spans(F.lit(0), m)).otherwise(in_parts(m)))


#: What `matches` returns.
SPANS = "array<struct<start:int,end:int,value:string>>"


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    reverse = F.transform(F.filter(F.split(F.reverse(digits(value)), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(reverse, lambda d, k: F.when(k % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return ~value.rlike(r"(^|\.)0*([1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(\.|$)")
    if kind == "card":
        return n.between(16, 19) & luhn(value)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, base (array of structs kind number, start, end), text: for every row."""
    # A text without the sign that a kind needs is not searched for it.
    needs = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains("text", F.lit("+"))}
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    out = docs
    for kind in KINDS:
        found = F.when(needs[kind], matches(F.col("text"), BASE[kind])).otherwise(none)
        out = out.withColumn(f"found_{kind}", found)
    return out


def checked_spans(number: int) -> Column:
    kind = KINDS[number]
    passed = F.filter(f"found_{kind}", lambda s: valid(kind, s["value"]))
    return F.transform(passed, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def count_kind(number: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{KINDS[number]}")


def candidates(texts: DataFrame) -> DataFrame:
    """row, kind, start, end and features of the spans that the wide generators find."""
    parts = []
    for number, kind in enumerate(KINDS):
        near = texts.where(F.col("text").rlike(WIDE[kind])) if kind != "email" else texts.where(F.contains("text", F.lit("@")) | F.col("text").rlike(r"(?i)[\[(]at[\])]"))
        spans = near.select("row", "text", F.explode(matches(F.col("text"), WIDE[kind])).alias("s")).select("row", F.lit(number).alias("kind"), "s.start", "s.end", "s.value", F.substring(F.col("text"), F.greatest(F.col("s.start") - 29, F.lit(1)), F.least(F.col("s.start"), F.lit(30))).alias("before"), F.substring(F.col("text"), F.col("s.end") + 1, F.lit(1)).alias("after"))
        parts.append(spans.select("row", "kind", "start", "end", *features(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Format and context features, each 0 or 1, so a kind has 256 combinations at most.
FEATURES = ("check", "plain", "cue", "edge_before", "edge_after", "length", "prefix", "varied")


def features(kind: str) -> list[Column]:
    value, n = F.col("value"), F.length(digits(F.col("value")))
    check = {"email": value.rlike(r"\.[A-Za-z]{2,}$"), "ip": valid("ip", F.regexp_replace(F.regexp_replace(value, r"\x20", ""), ",", ".")), "card": luhn(value), "phone": n.between(8, 15)}[kind]
    plain = ~value.rlike(r"[\[\](),_/\x20]") if kind != "phone" else value.rlike(r"[()\x20-]")
    length = {"email": F.length(value).between(6, 60), "ip": F.length(value).between(7, 15), "card": n == 16, "phone": n.between(10, 12)}[kind]
    prefix = {"email": F.contains(value, F.lit("@")), "ip": ~value.rlike("^0"), "card": value.rlike("^[3-6]"), "phone": F.startswith(value, F.lit("+"))}[kind]
    columns = (check, plain, F.col("before").rlike(CUES[kind]), ~F.col("before").rlike(r"[A-Za-z0-9]$"), ~F.col("after").rlike(r"[A-Za-z0-9]"), length, prefix, F.size(F.array_distinct(F.split(digits(value), ""))) > 4)
    return [F.coalesce(c, F.lit(False)).cast("int").alias(name) for c, name in zip(columns, FEATURES, strict=True)]


Tree = tuple[int, tuple[int, float, float], tuple[int, float, float]]


def boost(table: list[tuple[tuple[int, ...], int, int]], rounds: int = 20, rate: float = 0.4) -> list[Tree]:
    """Trees of depth 2 by gradient boosting of the logistic loss.

    table: feature combination, rows, rows with label 1; its size is bounded by the number of combinations. A tree
    is (feature, branch at 0, branch at 1), a branch (feature, leaf at 0, leaf at 1); leaves are Newton steps.
    """
    total, positive = sum(n for _, n, _ in table), sum(p for _, _, p in table)
    start = math.log((positive + 1) / (total - positive + 1))
    score = [start] * len(table)
    trees: list[Tree] = [(0, (0, start, start), (0, start, start))]
    width = len(FEATURES)

    def gain(g: float, h: float) -> float:
        return g * g / (h + 1)

    for _ in range(rounds):
        grads = []
        for (x, n, p), s in zip(table, score, strict=True):
            q = 1 / (1 + math.exp(-s))
            grads.append((x, p - n * q, n * q * (1 - q)))

        def split(rows: list) -> tuple[float, int]:
            best = (-1.0, 0)
            for f in range(width):
                sums = [[0.0, 0.0], [0.0, 0.0]]
                for x, g, h in rows:
                    sums[x[f]][0] += g
                    sums[x[f]][1] += h
                best = max(best, (gain(*sums[0]) + gain(*sums[1]), -f))
            return best[0], -best[1]

        top = split(grads)[1]
        branches = []
        for side in (0, 1):
            rows = [r for r in grads if r[0][top] == side]
            f = split(rows)[1] if rows else 0
            leaves = []
            for v in (0, 1):
                g, h = sum(r[1] for r in rows if r[0][f] == v), sum(r[2] for r in rows if r[0][f] == v)
                leaves.append(rate * g / (h + 1))
            branches.append((f, *leaves))
        trees.append((top, *branches))
        score = [s + branches[x[top]][1 + x[branches[x[top]][0]]] for (x, _, _), s in zip(table, score, strict=True)]
    return trees


def tree_score(trees: list[Tree]) -> Column:
    """The sum of the trees as one expression of CASE WHEN."""
    name = lambda f: F.col(FEATURES[f])
    leaf = lambda b: F.when(name(b[0]) == 1, F.lit(b[2])).otherwise(F.lit(b[1]))
    total = F.lit(0.0)
    for top, zero, one in trees:
        total = total + F.when(name(top) == 1, leaf(one)).otherwise(leaf(zero))
    return total


def score_of(trees: list[Tree], x: tuple[int, ...]) -> float:
    return sum((one if x[top] else zero)[1 + x[(one if x[top] else zero)[0]]] for top, zero, one in trees)


def threshold(trees: list[Tree], held: list[tuple[tuple[int, ...], int, int]], precision: float) -> float:
    """The lowest score at and above which held-out rows are positive at least that often; infinite if there is none."""
    ranked = sorted(((score_of(trees, x), n, p) for x, n, p in held), reverse=True)
    best, rows, hits = math.inf, 0, 0
    for s, n, p in ranked:
        rows, hits = rows + n, hits + p
        if hits >= precision * rows:
            best = s
    return best


def find_personal_data(docs: DataFrame, precision: float = 0.98) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row of docs (doc_id, text; others are ignored).

    Base spans are those of the patterns BASE that pass their kind's check. Candidates of the wider generators
    are added where the boosted trees' score reaches the kind's threshold and they touch no base span. There
    are no labels of personal data, so a candidate's label is whether a base span covers it exactly or overlaps it,
    which teaches format and context; the features leave out the plus and plain form in part, so that like
    spans score alike. Trees are fitted on rows with an even hash, thresholds on the others: the lowest score with the
    given precision. Null and empty texts have no spans; repeated rows are judged each; no documents give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    found = base_spans(texts)
    checked = [checked_spans(k) for k in range(len(KINDS))]
    base = written(found.select("doc_id", "row", F.concat(*checked).alias("base")), "base-spans")
    wide = written(candidates(texts).distinct(), "candidates")
    spans = base.where(F.size("base") > 0).select("row", F.explode("base").alias("b")).distinct().select(F.col("row").alias("of"), F.col("b.kind").alias("k"), F.col("b.start").alias("s"), F.col("b.end").alias("e"))
    touch = (F.col("row") == F.col("of")) & (F.col("kind") == F.col("k")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))
    labelled = written(wide.join(spans, touch, "left_semi").withColumn("label", F.lit(1)).unionByName(wide.join(spans, touch, "left_anti").withColumn("label", F.lit(0))), "labelled")
    # At most 2 * 4 * 256 combinations come to the driver.
    sums = labelled.groupBy("kind", (F.pmod("row", F.lit(2))).alias("fold"), *FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()
    added = None
    for number in range(len(KINDS)):
        table = lambda fold, number=number: [(tuple(r[f] for f in FEATURES), r.n, r.p) for r in sums if r.kind == number and r.fold == fold]
        if not table(0):
            continue
        trees = boost(sorted(table(0)))
        limit = threshold(trees, sorted(table(1)), precision)
        if math.isinf(limit):
            continue
        chosen = labelled.where((F.col("kind") == number) & (F.col("label") == 0)).where(tree_score(trees) >= limit - 1e-9).select("row", "kind", "start", "end")
        added = chosen if added is None else added.unionByName(chosen)
    if added is None:
        joined = base.withColumn("extra", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)"))
    else:
        each = added.join(spans.select("of", "s", "e"), (F.col("row") == F.col("of")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
        extra = written(each.distinct().groupBy(F.col("row").alias("at")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra")), "added-spans")
        joined = base.join(extra, F.col("row") == F.col("at"), "left").withColumn("extra", F.coalesce("extra", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"], s["end"])), ",")
    counts = [count_kind(k) for k in range(len(KINDS))]
    return joined.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
