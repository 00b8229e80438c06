"""Contracts against rules written out in Python, and their queries against SQL."""

import json

import duckdb
import pytest

from quillspark.operators import contracts
from quillspark.plans import all_queries

STEM = "A man of fifty comes in with pain in his chest that began two hours ago while he was at rest. He has had no fever, cough or injury, takes no drugs, and his blood pressure is normal. Which of these is the best next step?"
FOUR = [(x, f"option {x}") for x in "ABCD"]
Q = f"set_id long, position long, number long, stem string, choices {contracts.CHOICE}, correct string, objective string, explanation array<string>, target string, ranged boolean, detail string"


def question(position, **changes):
    base = {"set_id": 1, "position": position, "number": position, "stem": f"Case {chr(64 + position)}: {STEM}", "choices": FOUR, "correct": "B", "objective": f"goal {position}", "explanation": ["Choice A: x"], "target": f"t{position}", "ranged": False, "detail": "x"}
    return tuple((base | changes).values())


def found(df):
    return sorted((r.set_id, r.position or 0, r.severity, r.code, r.detail or "") for r in df.collect())


def test_a_sound_set_has_no_findings(spark):
    df = spark.createDataFrame([question(k) for k in range(1, 5)], Q)
    assert found(contracts.set_findings(df)) == [] == found(contracts.set_findings(df.where("1 = 0")))


def test_each_rule_of_a_set(spark):
    nine = [(x, x) for x in "ABCDEFGHI"]
    rows = [
        question(1, number=7), question(2, stem=None), question(3, stem="Short. Which one?"), question(4, stem=STEM.replace("Which of these is the best next step?", "Name the next step.")),
        question(5, stem=STEM + " All except one?"), question(6, choices=FOUR[:3]), question(7, choices=[*FOUR[:3], ("E", "x")]), question(8, correct="E"), question(9, objective=" "), question(10, explanation=None),
        question(11, explanation=["choice f : no", "Choice A: yes", "none"]), question(12, number=11), question(13, stem=f"Case K: {STEM}"), question(14, ranged=True, choices=nine, correct="I"), question(15, ranged=True, choices=nine[:1], correct="A"),
        question(16, objective="goal 1"), question(17, target="T1 "), question(18, target="t1"), question(19, choices=None),
    ]
    got = found(contracts.set_findings(spark.createDataFrame(rows, Q).repartition(4)))
    want = {
        (1, "NUMBER"), (2, "MISSING_STEM"), (3, "SHORT_STEM"), (4, "NO_QUESTION"), (5, "SHALLOW"), (5, "NO_QUESTION"), (6, "CHOICE_COUNT"), (6, "KEY_ABSENT"), (7, "LABELS"), (7, "REPEATED_NUMBER"), (8, "KEY"), (8, "KEY_ABSENT"), (9, "NO_OBJECTIVE"), (10, "NO_SECTIONS"),
        (11, "ABSENT_CHOICE"), (12, "NUMBER"), (12, "REPEATED_NUMBER"), (13, "REPEATED_QUESTION"), (15, "CHOICE_COUNT"), (15, "KEY_ABSENT"), (0, "OBJECTIVE_REPEATED"), (0, "TARGET_OVERUSED"), (19, "CHOICE_COUNT"), (19, "KEY_ABSENT"),
    }
    assert {(p, c) for _, p, _, c, _ in got} == want and len(got) == len(want)
    assert all(s == "error" for _, _, s, _, _ in got)
    details = {(p, c): d for _, p, _, c, d in got}
    assert (details[12, "REPEATED_NUMBER"], details[13, "REPEATED_QUESTION"], details[11, "ABSENT_CHOICE"], details[0, "TARGET_OVERUSED"]) == ("11", "11", "F", "t1")
    organic = {(p, c) for _, p, s, c, _ in found(contracts.set_findings(spark.createDataFrame(rows, Q), organic=True)) if s == "warning"}
    assert organic == {(3, "SHORT_STEM"), (0, "TARGET_OVERUSED")}


def test_figures_in_both_directions(spark):
    schema = f"set_id long, position long, stem string, explanation string, has_figure boolean, refs {contracts.REF}, images {contracts.IMAGE}, explanation_images {contracts.IMAGE}"
    ok = ("f1", "[FIGURE: f1]", "stem")
    image = lambda k, data="d", key=None: (k, data, key)
    rows = [
        (1, 1, "see [FIGURE: f1]", None, True, [ok], [image("f1")], None),
        (1, 2, None, None, None, None, None, None),
        (1, 3, "x", "[FIGURE: e] there", True, [("e", "[FIGURE: e]", "explanation")], None, [image("e")]),
        (1, 4, "x [FIGURE: g ]", None, False, [("f1", "[FIGURE: f1]", "stem"), ("", "", "explanation")], [image("h", "d", "k"), image("h", None, None)], [image("h")]),
        (2, 1, "[FIGURE: f1]", None, True, [ok], [image("f1")], []),
    ]
    got = {(s, p, c, d) for s, p, _, c, d in found(contracts.figure_findings(spark.createDataFrame(rows, schema).repartition(3)))}
    assert got == {
        (1, 4, "BOTH_PLACEMENTS", "h"), (1, 4, "IMAGE_WITHOUT_REF", "h"), (1, 4, "REF_INCOMPLETE", ""), (1, 4, "PLACEHOLDER_ABSENT", "[FIGURE: f1]"), (1, 4, "STEM_REF_WITHOUT_IMAGE", "f1"), (1, 4, "EXPLANATION_REF_WITHOUT_IMAGE", ""),
        (1, 4, "IMAGE_TWO_SOURCES", "h"), (1, 4, "IMAGE_NO_SOURCE", "h"), (1, 4, "IMAGE_REPEATED", "h"), (1, 4, "MARK_WITHOUT_REF", "g"), (1, 4, "FLAG_MISSING", ""), (1, 4, "ID_REUSED", "1"), (1, 4, "PLACEHOLDER_REUSED", "1"),
    }
    assert contracts.figure_findings(spark.createDataFrame([], schema)).count() == 0


def test_normalised_questions(spark):
    good = dict.fromkeys(contracts.REQUIRED, "x") | {f: [] for f in (*contracts.ARRAYS, "choices")} | {"schemaVersion": contracts.NORMALISED_VERSION, "sourceQuestionNumber": 3, "correctAnswer": "", "confidence": "low"}
    cases = {
        1: good, 2: {k: v for k, v in good.items() if k not in ("stem", "tags")}, 3: good | {"sourceQuestionNumber": "3", "confidence": None}, 4: good | {"choices": [{"label": "G", "text": "x"}, {"text": "y"}, "z"]},
        5: good | {"correctAnswer": "AB", "tags": None, "stem": "```JSON"}, 6: good | {"incorrectExplanations": [{"label": "A", "explanation": "eftab720"}, {}], "tags": ["below is the json", 5]}, 7: good | {"schemaVersion": 1, "sourceQuestionNumber": 1.5, "choices": "A"}, 8: [1],
    }
    rows = [*((k, json.dumps(v), "e") for k, v in cases.items()), (9, None, "e"), (10, "{", "e")]
    got = sorted((r.k, r.code, r.detail) for r in contracts.normalised_findings(spark.createDataFrame(rows, "k long, q string, code string"), "k", "q").collect())
    want = [
        (2, "MISSING_FIELD", "stem"), (2, "MISSING_FIELD", "tags"), (3, "CONFIDENCE", ""), (3, "NUMBER_TYPE", "STRING"), (4, "CHOICE_FIELD", "choices.label"), (4, "CHOICE_FIELD", "choices.label"), (4, "CHOICE_FIELD", "choices.text"), (4, "CHOICE_LABEL", "G"),
        (5, "ARRAY_TYPE", "tags"), (5, "FORBIDDEN_PHRASE", "stem: ```"), (5, "FORBIDDEN_PHRASE", "stem: ```json"), (5, "KEY", "AB"), (6, "EXPLANATION_FIELD", "incorrectExplanations.explanation"), (6, "EXPLANATION_FIELD", "incorrectExplanations.label"),
        (6, "FORBIDDEN_PHRASE", "incorrectExplanations: eftab720"), (6, "FORBIDDEN_PHRASE", "tags: below is the json"), (7, "CHOICES_TYPE", "STRING"), (7, "NUMBER_TYPE", "DECIMAL(2,1)"), (7, "VERSION", "1"), (8, "INVALID", None), (9, "INVALID", None), (10, "INVALID", None),
    ]
    assert got == want


def test_gates(spark):
    rows = [(1, "s", FOUR, "b ", 0.9), (2, " ", FOUR[:2], "B", 0.2), (3, "s", [("A", "x"), ("C", "y"), ("B", "z"), ("D", "w")], "C", None), (4, None, None, None, None)]
    got = {r.k: (r.warnings, r.blockers, r.usable, r.convertible) for r in contracts.extraction_gates(spark.createDataFrame(rows, f"k long, stem string, choices {contracts.CHOICE}, correct string, confidence double")).collect()}
    assert got[1] == ([], [], True, True)
    assert got[2] == (["missing stem", "fewer than 4 answer choices", "low extraction confidence"], [], False, True)
    assert got[3] == (["low extraction confidence"], ["labels are not sequential"], True, False)
    assert got[4][2:] == (False, False) and len(got[4][0]) == 4


def test_question_sets_are_read(spark, tmp_path):
    whole = {"schemaVersion": "v", "testTitle": "t", "questions": [{"stem": "a", "figureRefs": [{"id": "f2"}, {"figureId": "f1"}, {"placeholder": "p"}, {}, "s"], "images": [1, 2], "tables": "no", "extractionWarnings": ["w", "", None]}, {"stem": "b"}]}
    for name, text in {"a": json.dumps(whole, indent=1), "b": "{ broken", "c": "[]", "d": '{"questions": []}', "e": '{"x": 1}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {(r.file[-6], r.position): r for r in contracts.read_question_sets(spark, str(tmp_path)).collect()}
    first = got["a", 1]
    assert (first.figure_refs, first.attachments, first.warnings, first.error) == (["f1", "f2", "p", "s"], 7, ["w", ""], None)
    assert (got["a", 2].figure_refs, got["a", 2].attachments) == ([], 0)
    assert (got["b", None].error, got["d", None].error, got["e", None].error) == ("unreadable", None, "no questions array")
    assert got["d", None].question is None


@pytest.mark.parametrize("name", ["V03_normalised_contract", "V04_set_contract", "V07_figure_contract", "V14_extraction_gates", "C06_cost_batches", "C11_shared_options", "C13_joined_lines", "J20_suppressed_boxes", "W04_allocation"])
def test_queries_equal_sql(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = all_queries.queries()[name](spark, sf).toPandas()
    want = con.execute(all_queries.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want) and len(got)
    plain = lambda f: sorted(tuple("null" if x is None or x != x else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in f[sorted(f)].astype(object).where(f[sorted(f)].notna(), None).values.tolist())
    assert plain(got) == plain(want)


def test_failure_classes(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import text

    df = spark.createDataFrame([(1, "HTTP 429: Rate Limit"), (2, "urlopen error, quota exceeded"), (3, "truncation_unterminated_string"), (4, "TRUNCATION_unterminated_string"), (5, ""), (6, None)], "k long, m string")
    got = {r.k: r.c for r in df.select("k", text.failure_classes(F.col("m")).alias("c")).collect()}
    assert got == {1: ["quota"], 2: ["network", "quota"], 3: ["truncation"], 4: [], 5: [], 6: []}
