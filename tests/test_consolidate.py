"""Overlap in four parts against all pairs, and greedy consolidation against a replay of the whole sequence."""

import random
import re

import pytest

from quillspark.operators import consolidate

SCHEMA = "deck long, concept long, title string, facts array<string>, structured map<string,array<string>>, assets int, score double, n int"
NONE = (None, None, None, None)


def some(seed, n, decks=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("card", "neph", "pulm", "hema", "derm", "Onco") for b in ("itis", "osis", "emia", "pathy", "gram", "oma ")]
    pool = [" ".join(r.choice(words) for _ in range(r.randint(3, 7))) for _ in range(n // 3)]
    rows = []
    for k in range(n):
        title = r.choice(["Summary of things", *pool[:20]]) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(4))
        facts = [r.choice(pool) if r.random() < 0.6 else " ".join(r.choice(words) for _ in range(5)) for _ in range(r.choice([0, 1, 2, 3, 4, 6]))]
        structured = {"thresholds": [str(r.randint(1, 9)) for _ in range(r.randint(0, 3))], "steps": [r.choice(pool)]} if r.random() < 0.2 else None
        if rows and r.random() < 0.25:  # a near copy of an earlier one
            title, facts, structured = r.choice(rows)[2:5]
            facts = [*facts, "one more " + r.choice(words)] if r.random() < 0.5 else facts
        rows.append((k % decks, k, title, facts, structured, r.choice([0, 0, 1]), 1.0, 1))
    return rows


def key(x):
    return re.sub(r"\s+", " ", x).strip().lower()


def terms(x):
    return set(re.findall(r"(?<![a-z0-9])[a-z][a-z0-9+/-]{3,}", x.lower()))


class Concept:
    def __init__(self, row):
        _, self.id, self.title, facts, structured, assets, *_ = row
        self.title, self.structured = self.title or "", {k: {key(x) for x in v if key(x)} for k, v in (structured or {}).items()}
        values = [x for v in (structured or {}).values() for x in v]
        self.body = {key(x) for x in [*(facts or []), *values] if key(x)}
        self.facts = self.body | ({key(self.title)} if key(self.title) else set())
        self.own, self.more = terms(self.title), terms("\n".join([*(facts or []), *values]))
        self.terms = self.own | self.more
        self.info = 5 * len(facts or []) + len(self.terms) + 4 * (assets or 0)
        self.assets, self.cluster = assets, self.id

    def overlap(self, other):
        j = lambda x, y: len(x & y) / max(1, len(x | y))
        fact = len(self.facts & other.facts) / max(1, min(len(self.facts), len(other.facts)))
        structure = max([j(self.structured.get(k, set()), other.structured.get(k, set())) for k in {*self.structured, *other.structured}], default=0)
        term, title = j(self.terms, other.terms), j(self.own, other.own)
        score = max(fact, structure, term, 0.85 * title)
        found = [r for r, x in zip(consolidate.REASONS, (fact >= 0.5, structure >= 0.5, term >= 0.55, title >= 0.75 and score >= 0.65), strict=True) if x]
        return round(score, 3), found


def replay(rows):
    kept, out = [], {}
    for c in map(Concept, sorted(rows, key=lambda r: r[1])):
        if c.info < 10:
            out[c.id] = ("low_information", None, None)
            continue
        best, score, reasons = None, 0, []
        for k in kept:
            s, why = k.overlap(c)
            if s > score:
                best, score, reasons = k, s, why
        if best and score >= 0.78 and reasons:
            if c.info <= 12 and not c.assets:
                out[c.id] = ("suppress", best.id, best.cluster)
            else:
                out[c.id] = ("merge", best.id, best.cluster)
                best.facts, best.terms = best.facts | c.body, best.terms | c.more
                for name, values in c.structured.items():
                    best.structured[name] = best.structured.get(name, set()) | values
            continue
        if best and score >= 0.28 and reasons:
            c.cluster = best.cluster
        recap = re.search(r"\b(recap|summary|review|key points)\b", c.title.lower())
        out[c.id] = ("recap_only" if recap else "keep", None, c.cluster)
        if not recap:
            kept.append(c)
    return out


@pytest.mark.parametrize("direct", [1000, 10])
def test_greedy_consolidation_equals_the_replay(spark, direct):
    rows = some(1, 500)
    got = consolidate.consolidate(spark.createDataFrame(rows, SCHEMA).repartition(6), direct).collect()
    assert {r.concept: (r.disposition, r.duplicate_of, r.cluster) for r in got} == replay(rows)
    assert {r.disposition for r in got} == {"low_information", "suppress", "merge", "recap_only", "keep"}
    assert (max(r.together for r in got) == 500) == (direct == 1000)


def test_keepers_grow(spark):
    rows = [(1, 0, "Alpha thing", ["fact one here", "fact two here", "fact three", "fact four"], None, 1, 1.0, 1), (1, 1, "Alpha thing", ["fact one here", "fact two here", "fact three", "fact five more", "fact six more"], None, 1, 1.0, 1), (1, 2, "Other name", ["fact five more", "fact six more"], None, 1, 1.0, 1)]
    got = {r.concept: (r.disposition, r.duplicate_of, r.n_facts) for r in consolidate.consolidate(spark.createDataFrame(rows, SCHEMA)).collect()}
    # The third shares nothing with the first but what the second brought.
    assert got[1][:2] == ("merge", 0) and got[0][2] == 7
    assert got[2][:2] == ("keep", None) and got[2][2] == 3


@pytest.mark.parametrize("direct", [10, 500])
def test_overlaps_equal_all_pairs(spark, direct):
    rows = some(2, 300, decks=2)
    pairs, members = consolidate.overlaps(spark.createDataFrame(rows, SCHEMA).repartition(5), direct=direct)
    got = {(r.deck, r.a, r.b): (r.score, tuple(r.reasons)) for r in pairs.collect()}
    stands = {(r.deck, r.concept): r.representative for r in members.collect()}
    assert len(stands) == len(rows)
    made, want = [(r[0], Concept(r)) for r in rows], {}
    for i, (d, a) in enumerate(made):
        for e, b in made[i + 1 :]:
            same = d == e and (a.facts, a.terms, a.own, {k: v for k, v in a.structured.items() if v}) == (b.facts, b.terms, b.own, {k: v for k, v in b.structured.items() if v})
            assert same == (d == e and stands[d, a.id] == stands[e, b.id])
            if d == e and stands[d, a.id] == a.id and stands[e, b.id] == b.id:
                score, reasons = a.overlap(b)
                if score >= 0.45 and reasons:
                    want[d, a.id, b.id] = (score, tuple(reasons))
    assert got == want and len(want) > 50
    assert {x for _, reasons in want.values() for x in reasons} == set(consolidate.REASONS)


def test_consolidation_on_the_edges(spark):
    df = spark.createDataFrame([(None, 1, "t", None, None, None, 1.0, 1), (1, 1, *NONE, 1.0, 1), (1, 1, *NONE, 1.0, 1), (1, None, "x", [None, " "], {"a": None}, None, 1.0, 1), (2, 5, "Word " * 20_000, ["fact"] * 3, None, 0, 1.0, 1)], SCHEMA)
    got = sorted((r.deck, str(r.concept), r.disposition) for r in consolidate.consolidate(df).collect())
    assert got == [(1, "1", "low_information"), (1, "1", "low_information"), (1, "None", "low_information"), (2, "5", "keep")]
    none = df.where("1 = 0")
    assert consolidate.consolidate(none).count() == 0 and all(x.count() == 0 for x in consolidate.overlaps(none))


def test_sets_of_small_decks_stay_where_they_lie(spark):
    """Elements were dealt anew to meet, and whole sets moved twice more to be compared once pairs were too many for a broadcast."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, _ = consolidate.overlaps(spark.createDataFrame(some(2, 60, decks=2), SCHEMA))
        moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", pairs._jdf.queryExecution().executedPlan().toString())
        assert moved and all(re.fullmatch(r"deck#\d+L?", x) for x in moved)
        assert pairs.count() > 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
