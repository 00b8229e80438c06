"""Chunks of question texts, answer keys and note chunks against plain loops; numbering over ranges."""

import random
import re

import pytest

from quillspark.operators import question_text as Q
from quillspark.operators.tables import numbered

SF = "/root/testdata/sf0.001"


def chunks_by_hand(text):
    at = [m.start() for m in re.finditer(r"^(?:(?:Question|Item)\s+(\d+)[.):\s]|\*\s*(\d+)[.)]\s|(\d+)[.)]\s)", text, re.M | re.I)]
    out, seen = [], {}
    for k, (a, b) in enumerate(zip(at, [*at[1:], len(text)], strict=False), 1):
        part = text[a:b].strip()
        number = int(re.search(r"\d+", part)[0])
        why = []
        if number in seen:
            why.append(f"number repeated, first in chunk {seen[number]}")
        seen.setdefault(number, k)
        has = re.search(r"^\s*(?:\()?[A-Fa-f][.)]\s+\S", part, re.M)
        if len(part) < 80:
            why.append("short")
        if not has:
            why.append("no choices")
        if not re.search(r"\b(?:correct|incorrect|explanation|because|therefore|this patient|the answer|educational objective)\b", part, re.I):
            why.append("no explanation")
        why += [f"contamination: {p}" for p in Q.CONTAMINATION if p.lower() in part.lower()]
        out.append((k, number, part, ["low", "medium", "high"][bool(has) + (len(part) >= 80)], why))
    return out


def test_question_chunks(spark):
    r = random.Random(1)
    lines = ["1. Which?", "2) What is it that takes so many words to ask, and then some more to make it long enough?", "Question 3: x", "item 7. y", "* 9. z", "A) one", "(B) two", "c. three", "because of this", "EFTAB720 here", "12.5 no boundary", "", "1. again", "text"]
    made = {k: "\n".join(r.choice(lines) for _ in range(r.randint(0, 14))) for k in range(60)}
    docs = spark.createDataFrame([*((k, t, "n") for k, t in made.items()), (98, None, "n"), (99, "a" * 500_000 + "\n5. x", "n")], "doc_id long, text string, number string").repartition(5)
    chunks, files = Q.question_chunks(docs)
    got = {}
    for x in chunks.orderBy("doc_id", "position").collect():
        got.setdefault(x.doc_id, []).append((x.position, x.number, x.text, x.confidence, x.warnings))
    assert got == {**{k: c for k, t in made.items() if (c := chunks_by_hand(t))}, 99: [(1, 5, "5. x", "low", ["short", "no choices", "no explanation"])]}
    seen = {x.doc_id: x for x in files.collect()}
    assert len(seen) == 62 and seen[98].warnings == ["no question boundary"] and seen[99].warnings == ["characters before the first question: 500000"]
    for k, t in made.items():
        numbers = {n for _, n, *_ in chunks_by_hand(t)}
        gaps = sorted({*range(min(numbers), max(numbers) + 1)} - numbers) if numbers else []
        told = [w.removeprefix("missing numbers: ") for w in seen[k].warnings if w.startswith("missing")]
        spread = [n for w in told for part in w.split(", ") for a, b in [(part + "-" + part).split("-")[:2] if "-" not in part else part.split("-")] for n in range(int(a), int(b) + 1)]
        assert spread == gaps and (seen[k].status == "warning") == bool(seen[k].warnings)
    none = [x.count() for x in Q.question_chunks(docs.where("1 = 0"))]
    assert none == [0, 0]


@pytest.mark.parametrize(
    ("block", "loose", "strict"),
    [
        ("Stem\nA) one\nB) two\nCorrect Answer: B\nbecause so", ("B", "explicit"), ("B", "explicit")),
        ("Stem\nA) one\nB) two\nCorrect Answer C", ("C", "explicit"), (None, None)),
        ("A) one\nlong explanation\nB) two\nCorrect. It is so", ("B", "phrase"), (None, None)),
        ("A) one\nlong explanation of one\nB) two\nshorter one", ("A", "longest"), (None, None)),
        ("A) one\nB) - the reason is long\nC) x", ("B", "longest"), (None, None)),
        ("B) two\nA) one", ("B", "first"), (None, None)), ("nothing", (None, None), (None, None)),
    ],
)
def test_answers(block, loose, strict):
    assert Q.read_answer(block, False)[:2] == loose
    assert Q.read_answer(block, True)[:2] == strict


def test_answer_keys(spark):
    text = "Key\n1. x\nA) one\nCorrect answer: A\n 2) y\nB) two\nmore about two\n2. again\nC) three"
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, correct int")
    got = sorted((r.doc_id, r.number, r.correct, r.found_by) for r in Q.answer_keys(docs).collect())
    assert got == [(1, 1, "A", "explicit")] * 2 + [(1, 2, "C", "first")] * 2
    assert [(r.number, r.correct) for r in Q.answer_keys(docs.limit(1), strict=True).collect()] == [(1, "A")]
    assert Q.answer_keys(docs.where("1 = 0")).count() == 0


def test_note_chunks():
    assert Q.note_chunks("before\n# One\na\n# Two\nb", 100) == ["# One\na\n\n# Two\nb"]
    assert Q.note_chunks("aaa\n\nbbb\n\nccccccccc\n\nd", 8) == ["aaa\n\nbbb", "cccccccc", "c", "d"]
    assert Q.note_chunks("# A\n\nx\n\n# B\n\n" + "y" * 9, 9) == ["# A\n\nx", "# B", "y" * 9]
    assert Q.note_chunks("word word word", 9) == ["word", "word word"] and Q.note_chunks("a\n" * 5 + "b", 6) == ["a\na\na", "a\na\nb"]
    assert Q.note_chunks("HEART FAILURE:\nx\nKIDNEYS AND SKIN:\ny", 20) == ["HEART FAILURE:\nx", "KIDNEYS AND SKIN:\ny"]
    assert Q.note_chunks("") == [] == Q.note_chunks(" \n\n ")
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice(["word ", "\n", "\n\n", "longer-word", "x"]) for _ in range(r.randint(0, 40)))
        got = Q.note_chunks(text, 12)
        assert all(0 < len(c) <= 12 for c in got)
        assert "".join("".join(c.split()) for c in got) == "".join(text.split())
    assert sum(map(len, Q.note_chunks("x" * 3_000_000))) == 3_000_000


def test_note_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "a\n\nb", 0), (1, "a\n\nb", 0), (2, None, 0), (None, "c", 0)], "doc_id long, text string, chunk int")
    assert sorted((str(r.doc_id), r.chunk, r.text, r.n_chars) for r in Q.chunk_notes(docs).collect()) == [("1", 1, "a\n\nb", 4), ("1", 1, "a\n\nb", 4), ("None", 1, "c", 1)]


@pytest.mark.parametrize("groups", [["g"], []])
def test_numbers_over_ranges_equal_a_window(spark, groups):
    r = random.Random(7)
    rows = [(r.choice(["hot"] * 8 + ["b", None]), r.randint(0, 300), k) for k in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = numbered(spark.createDataFrame(rows, "g string, x int, id int").repartition(5), groups, ["x", "id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    seen, want = {}, set()
    for g, x, k in sorted(rows, key=lambda y: (y[1], y[2])):
        seen[g if groups else 0] = seen.get(g if groups else 0, 0) + 1
        want.add((g, x, k, seen[g if groups else 0]))
    assert {tuple(x) for x in got} == want and len(got) == 900
    assert numbered(spark.createDataFrame([], "g string, x int"), groups, ["x"]).count() == 0


@pytest.mark.parametrize("name", ["C01_note_chunks", "C03_question_chunks", "C10_answer_keys", "D05_greedy_consolidation", "J07_four_part_overlaps"])
def test_queries_run_on_whole_tables(spark, name):
    from quillspark.plans import all_queries

    assert all_queries.queries()[name](spark, SF).count() > 0
