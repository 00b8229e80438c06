"""Draft contracts, media routes, sections and review drafts on literal rows."""

import json

from pyspark.sql import functions as F

from quillspark.operators import drafts
from quillspark.operators.contracts import CHOICE

FOUR = [(x, f"option {x}") for x in "ABCD"]


def codes(df, key="k"):
    got = {}
    for r in df.collect():
        got.setdefault(r[key], set()).add(r.code)
    return got


def test_question_contract(spark):
    ok = (1, "Pain. What is it?", FOUR, "A", [("h", ["x"])], "t", "p")
    rows = [
        (1, *ok), (2, 0, None, FOUR[:3], "E", None, " ", None), (3, 3, "No question.", [*FOUR[:3], ("D", " ")], None, [("h", [" ", None]), ("i", None)], "t", "see ```"), (4, 4, "Pain, or not? Which", FOUR, "B", [("h", ["x"])], "t", "p"),
    ]
    df = spark.createDataFrame(rows, f"k long, number int, stem string, choices {CHOICE}, correct string, sections {drafts.SECTION}, tag string, pearl string")
    assert codes(drafts.question_findings(df, ["k"], ["```"])) == {
        2: {"NUMBER", "MISSING_STEM", "CHOICE_COUNT", "KEY", "NO_SECTIONS", "TAG", "PEARL"}, 3: {"NO_QUESTION", "EMPTY_CHOICE", "KEY", "EMPTY_SECTION", "FORBIDDEN"}, 4: {"NO_QUESTION"},
    }
    assert drafts.question_findings(df.where("1 = 0"), ["k"]).count() == 0


def test_bundle_contract(spark):
    chunk = lambda k, kind="text", version=drafts.SEGMENT_VERSION, grounded=True, refs=(): (k, version, kind, grounded, list(refs) if refs is not None else None, [], [], [])
    schema = "k long, schemaVersion string, chunkCount int, chunks array<struct<chunkId:string,schemaVersion:string,chunkType:string,grounded:boolean,imageRefs:array<string>,tableRefs:array<string>,warnings:array<string>,textBlocks:array<string>>>"
    rows = [(1, drafts.BUNDLE_VERSION, 2, [chunk("a"), chunk("b", "slide")]), (2, "x", 1, [chunk("a"), chunk("a", "song"), chunk(None, version=None, grounded=None, refs=None), chunk("a")]), (3, None, None, None), (4, drafts.BUNDLE_VERSION, 0, [])]
    got = {(r.k, r.place, r.code) for r in drafts.bundle_findings(spark.createDataFrame(rows, schema), "k").collect()}
    assert got == {
        (2, None, "schemaVersion"), (2, None, "chunkCount"), (2, 2, "repeated chunkId"), (2, 2, "chunkType"), (2, 3, "missing chunkId"), (2, 3, "chunk schemaVersion"), (2, 3, "sourceGrounding must be an object"), (2, 3, "imageRefs must be an array"), (2, 4, "repeated chunkId"),
        (3, None, "schemaVersion"), (3, None, "chunks must be an array"),
    }


def test_manifest_contract(spark):
    ok = {"manifestVersion": drafts.MANIFEST_VERSION, "jobId": "j", "sourceType": "s", "inputs": [{"path": "p"}], "dryRun": True, "destination": {}}
    cases = {1: ok | {"requiresGemini": False, "outputRoot": "r"}, 2: {k: v for k, v in ok.items() if k not in ("jobId", "inputs")}, 3: ok | {"manifestVersion": "2", "inputs": []}, 4: ok | {"inputs": "x", "requiresGemini": "no", "existingOutputValidation": 1, "outputRoot": None}, 5: [1]}
    df = spark.createDataFrame([*((k, json.dumps(v)) for k, v in cases.items()), (6, None), (7, "{")], "k long, m string")
    assert codes(drafts.manifest_findings(df, "k", "m")) == {
        2: {"missing jobId", "missing inputs"}, 3: {"unsupported manifestVersion", "inputs must be a non-empty array"}, 4: {"inputs must be a non-empty array", "requiresGemini must be boolean", "existingOutputValidation must be boolean", "outputRoot must be string"},
        5: {"INVALID"}, 6: {"INVALID"}, 7: {"INVALID"},
    }


def test_refined_drafts(spark):
    five = [*FOUR, ("e", "last")]
    whole = dict.fromkeys("ABCDE", "why")
    rows = [(1, "A stem that is long enough", five, "c", "A point.", whole), (2, "short", five[::-1], "F", "no", {**whole, "E": " "}), (3, None, None, None, None, None), (4, "A stem that is long enough", [*FOUR, ("E", "")], "A", "A point.", whole)]
    df = spark.createDataFrame(rows, f"k long, stem string, choices {CHOICE}, correct string, point string, rationales map<string,string>")
    every = {"SHORT_STEM", "SHORT_POINT", "KEY", "RATIONALE"}
    assert codes(drafts.draft_findings(df, "k")) == {2: every | {"LABELS"}, 3: every | {"CHOICE_COUNT"}, 4: {"EMPTY_CHOICE"}}


def test_assets(spark):
    refs = spark.createDataFrame([(1, "/r/a", "x"), (1, "/r/a", None), (2, "/r/a", "y"), (2, "/r/b", None), (2, "/r/b", None), (3, "/q/a", "x"), (3, "/r/../q", None), (4, " ", "x"), (4, None, "x"), (5, "/ra", "x")], "bundle long, path string, sha256 string")
    files = spark.createDataFrame([("/r/a", "x"), ("/q/a", "x"), ("/ra", "x")], "path string, sha256 string")
    got = {r.bundle: r.reasons for r in drafts.asset_reasons(refs, files, "/r").collect()}
    assert got == {2: ["normalized_asset_hash_mismatch", "normalized_asset_missing"], 3: ["normalized_asset_outside_job_root"], 5: ["normalized_asset_outside_job_root"]}


def test_media_routes(spark):
    q = [
        (1, 1, "s", "Stem [FIGURE: a]", [("a", "stem"), ("b", " Stem "), ("c", "explanation"), ("b", "stem"), ("zz", "stem"), ("d", "ignored"), ("d", None)]), (1, 2, "s", None, [("a", "stem"), ("a", "explanation"), ("b", "stem")]),
        (1, 3, "s", "x", None), (2, 1, "other", "x", [("a", "stem")]),
    ]
    questions = spark.createDataFrame(q, "set_id long, position long, source_id string, stem string, routes array<struct<imageId:string,placement:string>>").repartition(3)
    images = spark.createDataFrame([("s", "a", "diagnostic"), ("s", "b", None), ("s", "c", "x"), ("s", "d", "diagnostic")], "source_id string, image_id string, kind string")
    got = {(r.set_id, r.position): r for r in drafts.media_routes(questions, images).collect()}
    first = got[1, 1]
    assert (first.stem, first.stem_figures, first.explanation_figures, first.error) == ("Stem [FIGURE: a] [FIGURE: b]", ["a", "b"], ["c"], None)
    assert [(r.id, r.placeholder, r.location) for r in first.refs] == [("a", "[FIGURE: a]", "stem"), ("b", "[FIGURE: b]", "stem"), ("c", "[FIGURE: c]", "explanation")]
    assert got[1, 2].error.endswith("explanation: a") and got[1, 2].refs == [] and got[1, 2].stem == ""
    assert [(got[k].stem, got[k].refs) for k in ((1, 3), (2, 1))] == [("x", [])] * 2
    kinds = {(r.set_id, r.position): r.stem_figures for r in drafts.media_routes(questions, images, by_kind=True).collect()}
    assert kinds[1, 1] == ["a", "b", "d"]


def test_sections(spark):
    df = spark.createDataFrame([(1, " yes ", [("a", "no"), ("b", " "), (None, "x")], "goal", ["[FIGURE: f]"]), (2, None, None, " ", None)], "k long, c string, i array<struct<label:string,explanation:string>>, o string, f array<string>")
    got = {r.k: [(s.heading, s.body) for s in r.s] for r in df.select("k", drafts.explanation_sections(F.col("c"), F.col("i"), F.col("o"), F.col("f")).alias("s")).collect()}
    assert got == {1: [("Correct Answer Explanation", ["yes"]), ("Incorrect Answer Explanation", ["Choice A: no"]), ("Slide Figures", ["[FIGURE: f]"]), ("Educational Objective", ["goal"])], 2: []}
    other = df.where("k = 1").select(drafts.explanation_sections(F.col("c"), F.col("i"), F.col("o"), F.col("f"), by_choice=False)[1]["body"][0]).first()[0]
    assert other == "A. no"


def test_review_drafts(spark):
    questions = spark.createDataFrame([(s, p) for s in range(1, 6) for p in (1, 2, 3)] + [(1, 1)], "set_id long, position long")
    messages = [
        (1, "error", 2, "bad"), (1, "error", 2, "worse"), (1, "warning", None, "w"), (1, "semantic", 1, "s"), (2, "warning", 1, "w"), (3, "error", None, "x: schemaVersion must be y"), (3, "error", 1, "bad"),
        (4, "error", 1, "a"), (4, "error", 2, "b"), (4, "error", 3, "c"), (5, "error", None, "of the set"), (9, "error", 1, "no questions"),
    ]
    made, items = drafts.review_drafts(questions, spark.createDataFrame(messages, "set_id long, kind string, position long, message string"))
    assert sorted((r.set_id, r.n_questions, r.n_errors, r.valid) for r in made.collect()) == [(1, 3, 2, [1, 3]), (5, 3, 1, [1, 2, 3])]
    assert sorted((r.set_id, r.kind, r.severity, r.position or 0) for r in items.collect()) == [(1, "error", "error", 2), (1, "error", "error", 2), (1, "semantic", "warning", 1), (1, "warning", "warning", 0), (5, "error", "error", 0)]


def test_redo(spark):
    df = spark.createDataFrame([(1, "A", 3, ("B", 5, "stem"))], "k long, userAnswer string, timeSpent int, q struct<userAnswer:string,hintUsed:int,stem:string>")
    assert drafts.reset_for_redo(df).columns == ["k", "q"]
    assert drafts.reset_for_redo(df, column="q").schema["q"].dataType.names == ["stem"]
    assert drafts.reset_for_redo(df.select("k")).columns == ["k"]


def test_concept_contract(spark):
    ok = dict.fromkeys(drafts.CONCEPT_FIELDS, []) | {"conceptId": "c1", "title": "t", "sourceSlideIds": ["s"], "structuredImageFacts": {}, "imageTextQuality": "good", "dedupeDisposition": "keep", "overlapScore": 0.5, "images": [{"kind": "diagnostic"}, "x"]}
    bad = ok | {"conceptId": "", "title": "", "sourceSlideIds": [], "trapFacts": {}, "structuredImageFacts": [], "imageTextQuality": "best", "dedupeDisposition": None, "overlapScore": 1.5, "images": [{"kind": "photo"}, {}]}
    rows = [(1, 1, json.dumps(ok)), (1, 2, json.dumps(ok)), (2, 1, json.dumps(ok)), (1, 3, json.dumps(bad)), (1, 4, json.dumps({k: v for k, v in ok.items() if k != "tables"} | {"conceptId": "c4", "overlapScore": "x"})), (1, 5, "[]"), (1, 6, None)]
    got = sorted((r.deck, r.position, r.code, r.detail or "") for r in drafts.concept_findings(spark.createDataFrame(rows, "deck long, position int, c string").repartition(3), "deck", "c").collect())
    assert got == sorted([
        (1, 2, "repeated conceptId", "c1"), (1, 3, "missing conceptId", ""), (1, 3, "empty title", ""), (1, 3, "no source slides", ""), (1, 3, "not a list", "trapFacts"), (1, 3, "structured facts", ""), (1, 3, "image text quality", "best"), (1, 3, "disposition", ""),
        (1, 3, "overlap outside 0 to 1", ""), (1, 3, "image kind", "photo"), (1, 3, "image kind", ""), (1, 4, "missing key", "tables"), (1, 4, "not a list", "tables"), (1, 4, "overlap is no number", ""), (1, 5, "not an object", ""), (1, 6, "not an object", ""),
    ])


def test_atomic_lines(spark):
    from quillspark.operators import wrapped

    table = (["Drug", "Dose"], [["aspirin", " ", "100 mg"], [None, ""], None, ["x"]])
    rows = [(1, ["Oral\nintake of salt\nabc", None], "oral INTAKE of salt\n- last line here it is", [table, (None, [["only cells", "here"]])]), (2, None, None, None), (None, ["y" * 300 + "\nfive words in a line"], "", [])]
    df = spark.createDataFrame(rows, "slide_id long, blocks array<string>, notes string, tables array<struct<headers:array<string>,rows:array<array<string>>>>")
    got = {}
    for r in wrapped.atomic_lines(df).orderBy("slide_id", "k").collect():
        got.setdefault(r.slide_id, []).append(r.line)
    assert got == {1: ["Oral intake of salt abc", "oral INTAKE of salt", "last line here it is", "Drug: aspirin | 100 mg", "Drug: x", "only cells | here"], None: ["five words in a line"]}
    assert [r.line for r in wrapped.atomic_lines(df, "salt").collect()] == ["Oral intake of salt abc", "oral INTAKE of salt"]
    assert wrapped.atomic_lines(df.where("1 = 0")).count() == 0


def test_placements(spark):
    rows = [(1, "stem_image", ["a"], None), (2, "stem_image", ["a", "b"], []), (3, "table_image", None, ["a"]), (4, "explanation_image", ["a"], ["a"]), (5, "photo", ["a"], []), (6, None, None, None), (7, "table_image", [" "], ["a"])]
    df = spark.createDataFrame(rows, "k long, kind string, images array<string>, explanation_images array<string>")
    assert codes(drafts.placement_findings(df, ["k"])) == {2: {"PLACEMENT"}, 4: {"PLACEMENT", "BOTH_PLACEMENTS"}, 5: {"KIND"}, 6: {"KIND"}}


def test_strict_findings(spark):
    q = [
        (1, 1, "s", "A man with chest pain.", [("A", "give for 5 days"), ("B", "Chest  pain"), ("C", "pain")], ["drug", "drug", None], ["over 12 weeks", None], "Diagnosis"), (1, 2, "s", "Pain after medication initiation", [("A", "after medication")], None, None, "other"),
        (1, 3, "gone", "x", [("A", "9 weeks")], ["a", "b"], None, None), (1, 4, "s", None, None, None, None, None),
    ]
    df = spark.createDataFrame(q, f"set_id long, position long, source_id string, stem string, choices {CHOICE}, classes array<string>, claims array<string>, archetype string")
    sources = spark.createDataFrame([("s", "Treat   for 5 DAYS.")], "source_id string, text string")
    got = sorted((r.position, r.code, r.detail or "") for r in drafts.strict_findings(df, sources).collect())
    assert got == [(1, "choice_in_stem", "Chest  pain"), (1, "mixed_choice_classes", ""), (1, "unsupported_threshold", "12 weeks"), (2, "awkward_stem", "Pain after medication initiation")]


def test_user_functions(spark):
    from quillspark.functions import registry

    assert registry.register(spark) == registry.register(spark)
    spark.createDataFrame([(1, " A  b\tC\n", 85.0), (1, "xx\nyyy", 60.0), (1, "z", 1.0), (2, None, None)], "g long, t string, p double").createOrReplaceTempView("user_rows")
    got = spark.sql("SELECT normalize_key(t), clamp_text(t, 3), letter_grade(p) FROM user_rows WHERE g = 1 ORDER BY p DESC").collect()
    assert [tuple(r) for r in got] == [("a b c", "A b", "B"), ("xx yyy", "xx ", "D"), ("z", "z", "F")]
    lines = spark.sql("SELECT k, line FROM user_rows, LATERAL text_lines(t) WHERE p = 60 ORDER BY k").collect()
    assert [tuple(r) for r in lines] == [(1, "xx"), (2, "yyy")]
    assert {r.g: r.x for r in spark.sql("SELECT g, typical_text(t) AS x FROM user_rows GROUP BY g").collect()} == {1: "xx\nyyy", 2: None}
