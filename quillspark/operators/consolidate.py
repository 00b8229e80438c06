"""Overlap of concepts in four parts, and greedy consolidation whose keepers grow by what they absorb.

A concept has a title, facts (strings), structured facts (lists of strings by name) and a number of assets. Concepts are
compared inside their deck only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normalize_key
from quillspark.operators.links import components
from quillspark.operators.tables import fold_groups, written

# What a part must reach to be a reason, the weight of titles, and where concepts are one, or one cluster.
FACT_REASON, STRUCTURE_REASON, TERM_REASON, TITLE_REASON, TITLE_SCORE = 0.5, 0.5, 0.55, 0.75, 0.65
TITLE_WEIGHT = 0.85
SAME, CLUSTER, REPORT = 0.78, 0.28, 0.45
LOW_INFORMATION, LITTLE_INFORMATION = 10, 12
RECAP = r"\b(recap|summary|review|key points)\b"
REASONS = ("repeated fact block", "repeated structured block", "near-duplicate term set", "title plus content overlap")


def terms(c: Column, generic: Sequence[str] = ()) -> Column:
    """Distinct lower-case terms of four or more characters, without generic ones; hashed, since sets are only compared."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?<![a-z0-9])[a-z][a-z0-9+/-]{3,}"), F.lit(0))
    return hashed(F.array_except(found, F.array(*map(F.lit, generic)).cast("array<string>")))


def hashed(strings: Column) -> Column:
    """64-bit hashes in place of strings: a fraction of the bytes to move, and two different strings of a deck practically never agree."""
    return F.transform(strings, lambda x: F.xxhash64(x))


def prepared(concepts: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """deck, concept, and the sets that are compared: fact_keys (with the title), body_keys (without), own_terms (of the title), fact_terms, structure; info, rich, recap."""
    facts = F.filter(F.coalesce("facts", F.array().cast("array<string>")), lambda x: x.isNotNull())
    structured = F.map_filter(F.coalesce("structured", F.create_map().cast("map<string,array<string>>")), lambda _, v: v.isNotNull())
    title, assets = F.coalesce("title", F.lit("")), F.coalesce(F.col("assets").cast("long"), F.lit(0))
    clean = lambda a: F.array_distinct(hashed(F.filter(F.transform(a, normalize_key), lambda x: x != "")))
    values = F.flatten(F.map_values(structured))
    df = concepts.select("deck", "concept", title.alias("title"), facts.alias("facts"), structured.alias("structured"), values.alias("values"), assets.alias("assets"))
    # Terms are found once, before anything counts them.
    df = df.withColumns({"own_terms": terms(F.col("title"), generic), "fact_terms": terms(F.array_join(F.concat("facts", "values"), "\n"), generic)})
    return df.select(
        "deck", "concept", clean(F.concat(F.array("title"), "facts", "values")).alias("fact_keys"), clean(F.concat("facts", "values")).alias("body_keys"), "own_terms", "fact_terms",
        F.map_filter(F.transform_values("structured", lambda _, v: clean(v)), lambda _, v: F.size(v) > 0).alias("structure"),
        (F.size("facts") * 5 + F.size(F.array_union("own_terms", "fact_terms")) + F.col("assets") * 4).cast("long").alias("info"),
        (F.col("assets") > 0).alias("rich"), F.lower("title").rlike(RECAP).alias("recap"),
    )


def _linked(sets: DataFrame, by_deck: bool = False) -> DataFrame:
    """Pairs (deck, a, b) that may have a reason: they share one of the rarest elements that a part's bound asks for.

    Of a set of n elements a similar one has `need` at least, so it has one of the n - need + 1 rarest; of two sets whose
    overlap counts by the smaller one, that holds for the smaller, whatever of the larger it meets. Elements that only one
    concept of the deck has are the rarest and meet nothing, so they leave after the first shuffle, and with them the sets
    that have too few others.

    by_deck: sets lie deck by deck, and stay there: the concepts of an element are paired within its list.
    """
    kind = lambda name, bound, values: F.struct(F.lit(name).alias("kind"), F.lit(float(bound)).alias("bound"), values.alias("elements"))
    parts = F.array(kind("fact", FACT_REASON, F.col("fact_keys")), kind("term", TERM_REASON, F.col("terms")), kind("title", TITLE_SCORE / TITLE_WEIGHT, F.col("title_terms")))
    lists = F.transform(F.map_entries("structure"), lambda e: F.struct(F.concat(F.lit("list "), e["key"]).alias("kind"), F.lit(float(STRUCTURE_REASON)).alias("bound"), e["value"].alias("elements")))
    groups = sets.select("deck", "concept", F.inline(F.concat(parts, lists)))
    sized = groups.withColumn("n", F.size("elements")).withColumn("need", F.ceil(F.col("n") * F.col("bound") - 1e-9).cast("int"))
    spread = sized.select("deck", "concept", F.xxhash64("kind").alias("part"), (F.col("kind") == "fact").alias("by_smaller"), "n", "need", F.explode("elements").alias("element"))
    met = spread.withColumn("sets", F.count("*").over(Window.partitionBy("deck", "part", "element"))).where("sets > 1")
    own = Window.partitionBy("deck", "concept", "part")
    ranked = met.withColumn("others", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("sets", "element")))
    ranked = ranked.withColumn("head", F.col("rank") <= F.col("others") - F.col("need") + 1).where("head OR by_smaller")
    if by_deck:
        side = F.struct("concept", "n", "need", "head")
        lists = ranked.groupBy("deck", "part", "element").agg(F.first("by_smaller").alias("by_smaller"), F.collect_list(side).alias("y")).where("size(y) > 1")
        heads = lists.select("deck", "by_smaller", "y", F.explode(F.filter("y", lambda v: v["head"])).alias("x"))
        both = heads.select("deck", "by_smaller", "x", F.explode("y").alias("y")).select("deck", "by_smaller", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "xy" for c in ("concept", "n", "need", "head")))
        return _fitting(both.where("x_concept <> y_concept"))
    x, y = (ranked.select("deck", "part", "element", "by_smaller", *(F.col(c).alias(f"{p}_{c}") for c in ("concept", "n", "need", "head"))) for p in "xy")
    return _fitting(x.where("x_head").join(y.drop("by_smaller"), ["deck", "part", "element"]).where("x_concept <> y_concept"))


def _fitting(both: DataFrame) -> DataFrame:
    fits = F.when(F.col("by_smaller"), F.col("x_n") <= F.col("y_n")).otherwise(F.col("y_head") & (F.greatest("x_need", "y_need") <= F.least("x_n", "y_n")))
    return both.where(fits).select("deck", F.least("x_concept", "y_concept").alias("a"), F.greatest("x_concept", "y_concept").alias("b")).distinct()


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def scored(pairs: DataFrame, sets: DataFrame, by_deck: bool = False) -> DataFrame:
    """pairs (deck, a, b) with score and reasons, worked out from the whole sets.

    by_deck: both lie deck by deck, and stay there: of a deck's concepts, few as they are, the pair's are picked out.
    """
    side = lambda p: sets.select("deck", F.col("concept").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("fact_keys", "terms", "title_terms", "structure")))
    if by_deck:
        # Spark takes no key from a condition within coalesce, and so moves nothing by it.
        x, y = (side(p).withColumnsRenamed({"deck": f"{p}_deck", p: f"{p}_concept"}) for p in "ab")
        both = pairs.join(x, F.col("deck") == F.col("a_deck")).where(F.coalesce(F.col("a") == F.col("a_concept"), F.lit(False)))
        both = both.join(y, F.col("deck") == F.col("b_deck")).where(F.coalesce(F.col("b") == F.col("b_concept"), F.lit(False)))
    else:
        both = pairs.join(side("a"), ["deck", "a"]).join(side("b"), ["deck", "b"])
    c = F.col
    fact = F.size(F.array_intersect("a_fact_keys", "b_fact_keys")) / F.greatest(F.lit(1), F.least(F.size("a_fact_keys"), F.size("b_fact_keys")))
    none = F.array().cast("array<long>")
    names = F.array_union(F.map_keys("a_structure"), F.map_keys("b_structure"))
    structure = F.array_max(F.transform(names, lambda k: jaccard(F.coalesce(F.element_at("a_structure", k), none), F.coalesce(F.element_at("b_structure", k), none))))
    parts = both.select("deck", "a", "b", fact.alias("fact"), F.coalesce(structure, F.lit(0.0)).alias("structure"), jaccard(c("a_terms"), c("b_terms")).alias("term"), jaccard(c("a_title_terms"), c("b_title_terms")).alias("title"))
    score = F.greatest("fact", "structure", "term", c("title") * TITLE_WEIGHT)
    holds = (c("fact") >= FACT_REASON, c("structure") >= STRUCTURE_REASON, c("term") >= TERM_REASON, (c("title") >= TITLE_REASON) & (score >= TITLE_SCORE))
    reasons = F.array_compact(F.array(*(F.when(x, F.lit(r)) for x, r in zip(holds, REASONS, strict=True))))
    return parts.select("deck", "a", "b", F.bround(score, 3).alias("score"), reasons.alias("reasons"))


def _with_terms(sets: DataFrame) -> DataFrame:
    return sets.withColumn("terms", F.array_union("own_terms", "fact_terms")).withColumn("title_terms", F.col("own_terms"))


def _hot_decks(concepts: DataFrame, direct: int) -> DataFrame | None:
    """Decks of over `direct` concepts, or None if there are none."""
    hot = written(concepts.groupBy("deck").agg(F.count("*").alias("size")).where(F.col("size") > direct).select("deck"), "concept-decks")
    return None if hot.isEmpty() else hot


def overlaps(concepts: DataFrame, generic: Sequence[str] = (), direct: int = 500) -> tuple[DataFrame, DataFrame]:
    """Pairs of different concepts that overlap, and which concept stands for each.

    concepts: deck, concept (unique in its deck), title, facts, structured, assets. First result: deck, a, b, score, reasons:
    pairs a < b of representatives with score >= REPORT and a reason. Second: deck, concept, representative: concepts with
    equal sets have the smallest one's id; they overlap wholly and are not paired.

    The score is the largest of: shared facts over the smaller set of facts, the best Jaccard similarity of a structured list,
    that of terms, and TITLE_WEIGHT of that of title terms. A pair has a reason only above its part's bound, so candidates
    share one of the rarest elements that the bound asks for, in any of the four parts; none is lost. Nulls are empty,
    empty sets overlap with nothing, concepts without a deck with none. No concepts: none.

    Sets of decks of up to `direct` concepts move deck by deck, once to find equal ones and once to be compared, where they stay;
    larger decks are dealt by their elements.
    """
    hot = _hot_decks(concepts, direct)
    sets = _with_terms(prepared(concepts, generic)).select("deck", "concept", "fact_keys", "terms", "title_terms", "structure")
    key = F.xxhash64(*(F.array_sort(c) for c in ("fact_keys", "terms", "title_terms")), F.array_sort(F.map_entries(F.transform_values("structure", lambda _, v: F.array_sort(v)))).cast("string"))
    small, large = (sets, None) if hot is None else (sets.join(hot, "deck", "left_anti"), sets.join(hot, "deck", "left_semi"))
    members = small.repartition("deck") if large is None else small.repartition("deck").unionByName(large)
    members = members.withColumn("representative", F.min("concept").over(Window.partitionBy("deck", key)))
    chosen = written(members.where("concept = representative").drop("representative"), "concepts")
    few = (chosen if hot is None else chosen.join(hot, "deck", "left_anti")).where("deck IS NOT NULL").repartition("deck")
    pairs = scored(_linked(few, by_deck=True), few, by_deck=True)
    if hot is not None:
        many = chosen.join(hot, "deck", "left_semi")
        pairs = pairs.unionByName(scored(_linked(many), many))
    pairs = pairs.where((F.col("score") >= REPORT) & (F.size("reasons") > 0))
    return pairs, members.select("deck", "concept", "representative")


FOLDED = ("fact_keys", "body_keys", "title_terms", "terms", "fact_terms")


@dataclass
class Keeper:
    concept: int
    facts: set[int]
    body: set[int]
    own: set[int]
    terms: set[int]
    fact_terms: set[int]
    structure: dict[str, set[int]]
    cluster: int
    absorbed: list[int] = field(default_factory=list)

    def overlap(self, other: Keeper) -> tuple[float, bool]:
        """Score (3 decimals) and whether there is a reason."""
        fact = len(self.facts & other.facts) / max(1, min(len(self.facts), len(other.facts)))
        term = len(self.terms & other.terms) / max(1, len(self.terms | other.terms))
        title = len(self.own & other.own) / max(1, len(self.own | other.own))
        names = self.structure.keys() | other.structure.keys()
        lists = [(self.structure.get(k, set()), other.structure.get(k, set())) for k in names]
        structure = max((len(x & y) / max(1, len(x | y)) for x, y in lists), default=0.0)
        score = max(fact, structure, term, title * TITLE_WEIGHT)
        reason = fact >= FACT_REASON or structure >= STRUCTURE_REASON or term >= TERM_REASON or (title >= TITLE_REASON and score >= TITLE_SCORE)
        return round(score, 3), reason

    def absorb(self, other: Keeper) -> None:
        """Takes over facts, their terms and structured lists; the title stays."""
        self.facts |= other.body
        self.terms |= other.fact_terms
        for name, values in other.structure.items():
            self.structure[name] = self.structure.get(name, set()) | values
        self.absorbed.append(other.concept)

    def grown(self) -> dict:
        return {"fact_keys": list(self.facts), "terms": list(self.terms), "structure": [(k, list(v)) for k, v in self.structure.items()]}


def fold(rows: list[dict]) -> list[tuple]:
    """(concept, disposition, duplicate_of, cluster, score, number of facts, and what a keeper that grew has in the end) of one deck's concepts, in order."""
    kept: list[Keeper] = []
    out: list[list] = []
    for r in rows:
        me = Keeper(r["concept"], *(set(r[c]) for c in FOLDED), {x["key"]: set(x["value"]) for x in r["structure"]}, r["concept"])
        if r["info"] < LOW_INFORMATION:
            out.append([me, "low_information", None, None, 0.0])
            continue
        best, score, reason = None, 0.0, False
        for k in kept:
            found, why = k.overlap(me)
            if found > score:
                best, score, reason = k, found, why
        if best and score >= SAME and reason:
            if r["info"] <= LITTLE_INFORMATION and not r["rich"]:
                out.append([me, "suppress", best.concept, best.cluster, score])
            else:
                best.absorb(me)
                out.append([me, "merge", best.concept, best.cluster, score])
            continue
        near = bool(best) and score >= CLUSTER and reason
        if near:
            me.cluster = best.cluster
        if not r["recap"]:
            kept.append(me)
        out.append([me, "recap_only" if r["recap"] else "keep", None, me.cluster, score if near else 0.0])
    return [(me.concept, kind, of, cluster, score, len(me.facts), me.grown() if me.absorbed else None) for me, kind, of, cluster, score in out]


RESULT = "deck long, concept long, disposition string, duplicate_of long, cluster long, score double, n_facts long, together long"
GROWN = "grown struct<fact_keys: array<long>, terms: array<long>, structure: map<string, array<long>>>"


def _folded(sets: DataFrame, grown: bool) -> DataFrame:
    """RESULT for each (deck, component) of sets, and with grown the sets of keepers that grew."""

    def run(group: list[dict]) -> list[dict]:
        names = ("concept", "disposition", "duplicate_of", "cluster", "score", "n_facts", "grown")
        return [dict(zip(names, x, strict=True), deck=group[0]["deck"], together=len(group)) for x in fold(group)]

    rows = sets.select("deck", "component", F.col("concept").cast("long").alias("concept"), *FOLDED, F.map_entries("structure").alias("structure"), "info", "rich", "recap")
    done = fold_groups(rows, ["deck", "component"], ["concept"], run, f"{RESULT}, {GROWN}")
    return done if grown else done.drop("grown")


def _in_components(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with component: the smallest node that links (deck, a, b) reach, or a node of its own."""
    pairs = links.select(F.xxhash64("deck", "a").alias("a"), F.xxhash64("deck", "b").alias("b"))
    own = sets.withColumn("node", F.xxhash64("deck", "concept"))
    return own.join(components(pairs), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def consolidate(concepts: DataFrame, direct: int = 500, generic: Sequence[str] = (), rounds: int = 20) -> DataFrame:
    """Each concept's fate when a deck's concepts are taken in order: deck, concept, disposition, duplicate_of, cluster, score, n_facts, together.

    concepts as for `overlaps`, with long decks and concepts. Of little information: low_information. Else it is compared with
    all keepers so far, of which the first with the highest score counts: from SAME on, with a reason, it is suppressed (if
    it has little information and no assets) or merged into that keeper, which grows by its facts and terms, so that later
    scores change; from CLUSTER on it joins the keeper's cluster. Otherwise, and then too, it is kept, unless its title says
    that it only sums up (recap_only). n_facts: distinct facts at the end; together: concepts folded in one task.

    Decks of up to `direct` concepts are folded whole. A larger one is first cut into components of concepts that overlap
    (`overlaps`), and each is folded by itself. Where a keeper, as it has grown, overlaps with a concept of another component,
    the two become one and are folded again, until there are no such pairs. The result is that of folding the deck whole,
    unless a keeper resembles such a concept for a while only, before it grows on. together shows hot components. Null decks are
    left out; nulls inside a concept are empty; repeated (deck, concept) are folded each. No concepts: none.
    """
    known = concepts.where("deck IS NOT NULL")
    sets = _with_terms(prepared(known, generic))
    whole = sets.withColumn("component", F.lit(0).cast("long"))
    hot = _hot_decks(known, direct)
    if hot is None:
        return _folded(whole, False)
    result = _folded(whole.join(hot, "deck", "left_anti"), False)
    large = written(sets.join(hot, "deck", "left_semi"), "concepts-large")
    links = written(scored(_linked(large), large).where(F.size("reasons") > 0).select("deck", "a", "b"), "concept-links")
    for _ in range(rounds):
        parts = written(_in_components(large, links), "concept-parts")
        done = written(_folded(parts, True), "concept-folds")
        grown = done.where("grown IS NOT NULL").select("deck", "concept", "grown")
        now = parts.join(grown, ["deck", "concept"], "left")
        now = written(now.withColumns({c: F.coalesce(F.col("grown")[c], c) for c in ("fact_keys", "terms", "structure")}).withColumn("grew", F.col("grown").isNotNull()).drop("grown"), "concepts-grown")
        side = lambda p: now.select("deck", F.col("concept").alias(p), F.col("component").alias(f"{p}_part"), F.col("grew").alias(f"{p}_grew"))
        met = _linked(now).join(side("a"), ["deck", "a"]).join(side("b"), ["deck", "b"]).where("a_part <> b_part AND (a_grew OR b_grew)").select("deck", "a", "b")
        more = written(scored(met, now).where(F.size("reasons") > 0).select("deck", "a", "b"), "concept-links")
        if more.isEmpty():
            return result.unionByName(done.drop("grown"))
        links = links.unionByName(more)
    raise RuntimeError("components did not settle")
