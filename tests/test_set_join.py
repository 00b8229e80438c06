"""The exact join of sets against all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import links, set_join
from quillspark.plans import all_queries


def made(n: int = 260) -> dict[int, list[int]]:
    """Sets of 1 to 300 elements of a small vocabulary, many near one another, some equal, some empty."""
    dice, out = random.Random(5), {}
    for k in range(n):
        if k % 3 and out:
            base = dice.choice(list(out.values()))
            new = {dice.randrange(2000) if dice.random() < dice.choice((0, 0.05, 0.2)) else x for x in base}
            new = set(sorted(new)[: dice.randint(1, len(new))]) if new and k % 5 == 0 else new
        else:
            new = {min(dice.randrange(2000), dice.randrange(2000)) for _ in range(dice.choice((0, 1, 2, 20, 60, 300)))}
        out[k * 3] = sorted(new)
    return out


@pytest.mark.parametrize("threshold", [0.65, 0.85, 1.0])
@pytest.mark.parametrize("small", [False, True])
def test_join_equals_all_pairs(spark, monkeypatch, threshold, small):
    if small:  # few pairs at once (in the driver's own process and in new tasks)
        monkeypatch.setattr(set_join, "PAIRS", 7)
    sets = {k: [x * 7919 - 5_000_000 for x in v] for k, v in made().items()}
    pairs, classes = set_join.similar(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, elements array<long>"), threshold)
    first = {}
    for k, v in sorted(sets.items()):
        first.setdefault(tuple(v), k)
    want = {(a, b, round(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])), 9)) for a, b in combinations(sorted(first[v] for v in first if v), 2) if len(set(sets[a]) & set(sets[b])) >= threshold * len(set(sets[a]) | set(sets[b]))}
    assert {(r.a, r.b, round(r.similarity, 9)) for r in pairs.collect()} == want
    equal = list(map(tuple, sets.values()))
    assert {tuple(r) for r in classes.collect()} == {(k, first[tuple(v)], equal.count(tuple(v))) for k, v in sets.items() if v}


def test_unlike_sets_that_share_an_element_are_not_written(spark):
    """One common element made a candidate of every pair before; now none of these 124,750 is."""
    sets = [(k, sorted([1, *range(1000 + k % 250 * 40, 1039 + k % 250 * 40)])) for k in range(0, 500)]
    sets = [(k, [x + (k >= 250) * 20 if x > 1 else x for x in v]) for k, v in sets]
    df = spark.createDataFrame(sets, "id long, elements array<long>")
    assert set_join.candidates(df, 0.65).count() == 0


def test_join_in_many_ranges_without_broadcasts(spark, monkeypatch):
    """Few elements a range, and ids of copies and pairs joined by shuffles: the same pairs and classes as in one range."""
    df = spark.createDataFrame([(k, [x * 7919 - 5_000_000 for x in v]) for k, v in made().items()], "id long, elements array<long>")
    want = [sorted(map(tuple, x.collect())) for x in set_join.similar(df, 0.65)]
    monkeypatch.setattr(set_join, "ELEMENTS_A_RANGE", 900)
    monkeypatch.setattr(set_join, "BROADCAST_IDS", 0)
    assert [sorted(map(tuple, x.collect())) for x in set_join.similar(df, 0.65)] == want and want[0]


def test_large_sets_travel_once_a_range(spark):
    """A profile for each element took bytes by the square of a set's size: 44 MB of profiles for these forty sets of 0.96 MB."""
    dice = random.Random(3)
    base = [dice.getrandbits(62) for _ in range(6000)]
    sets = [(k, sorted(dice.sample(base, 3000))) for k in range(40)]
    df = spark.createDataFrame(sets, "id long, elements array<long>")
    sent = set_join.entries(df, 0.65).agg(F.sum(F.length("data"))).first()[0]
    assert sent < 1_000_000


def test_no_sets(spark):
    pairs, classes = set_join.similar(spark.createDataFrame([(1, []), (2, None)], "id long, elements array<long>"), 0.65)
    assert pairs.count() == 0 and classes.count() == 0


COPIED = ["J07_similarity_join", "D06_clusters_by_type", "D06_two_thresholds", "D05_consolidate", "W12_time_penalty"]


@pytest.mark.parametrize("name", COPIED)
def test_copies_and_near_copies_as_in_sql(spark, tmp_path, name):
    """Forty copies of one text and thirty near copies of another, in two languages; before, each pair of copies was a row or a link."""
    words = [a + b for a in ("amber", "cedar", "delta", "flint", "grove") for b in ("wick", "ford", "mere", "stone", "hill")]
    texts = [" ".join(words[:12])] * 40 + [" ".join([*words[12:24], words[k % 6]]) for k in range(30)] + ["", None, "of a the", *(" ".join(words[k : k + 5]) for k in range(20))]
    rows = [(k, x, ("en", "de", "en")[k % 3], "s", len(x or "")) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(all_queries.oracle_sql()[name]).df()
    got = all_queries.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist())) and len(got)


@pytest.mark.parametrize("block", [4, 512])
def test_near_copies_move_once_a_group(spark, monkeypatch, block):
    """Before, the sets of both ends moved with each of these 1,770 pairs; in blocks a set moves once for each other block at most."""
    dice, counts = random.Random(8), {}
    sets = {k: sorted({*range(1, 100), *dice.sample(range(1000, 2000), 6)}) for k in range(60)}
    monkeypatch.setattr(set_join, "BLOCK", block)
    monkeypatch.setattr(set_join, "COLUMNS", 64)
    write = set_join.written

    def counted(df, name):
        out = write(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(set_join, "written", counted)
    pairs, _ = set_join.similar(spark.createDataFrame(list(sets.items()), "id long, elements array<long>"), 0.65)
    want = {(a, b, round(len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])), 9)) for a, b in combinations(sorted(sets), 2)}
    assert {(r.a, r.b, round(r.similarity, 9)) for r in pairs.collect()} == want
    assert counts["set-pairs"] == 1770
    assert counts["set-places"] == 60 if block == 512 else counts["set-places"] <= 60 * 15


def test_thinned_links_reach_the_same(spark):
    dice = random.Random(4)
    rows = [(dice.randrange(300), dice.randrange(300)) for _ in range(170)] + [(b, a) for a, b in combinations(range(400, 440), 2)]
    df = spark.createDataFrame(rows, "a long, b long")
    thin = links.thinned(df)
    assert thin.count() <= 170 * 2 + 40
    assert sorted(map(tuple, links.components(thin).collect())) == sorted(tuple(r) for r in links.components(df.where("a <> b")).collect())


@pytest.mark.parametrize("block, ids", [(3, 0), (512, 300_000)])
def test_all_pairs_of_copies_are_linked(spark, tmp_path, monkeypatch, block, ids):
    """Each copy was linked with the smallest one only, and stood for none of its pairs with other texts."""
    monkeypatch.setattr(set_join, "BLOCK", block)
    monkeypatch.setattr(set_join, "BROADCAST_IDS", ids)
    base = [a + b for a in ("amber", "cedar", "delta") for b in ("wick", "ford", "mere", "stone")]
    texts = [" ".join(base[:9]), " ".join(base[:10]), " ".join(base[2:11]), "other words stand alone"]
    rows = [(7 * k % 60, texts[0 if k < 20 else 1 if k < 35 else 2 + k % 2 * (k < 50)] + " 12" * k) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {k: frozenset(w for w in x.split() if w.isalpha()) for k, x in rows}
    want = {(a, b): len(rows[a] & rows[b]) / len(rows[a] | rows[b]) for a, b in combinations(sorted({7 * k % 60 for k in range(60)}), 2)}
    want = {p: s for p, s in want.items() if s >= 0.65}
    got = all_queries.queries()["J07_similarity_join"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == {p: round(s, 6) for p, s in want.items()}
    got = all_queries.queries()["W12_time_penalty"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == {(a, b): round(s - 0.2 * (b - a > 10), 6) for (a, b), s in want.items()}
