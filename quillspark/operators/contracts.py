"""Contracts of question sets: rules over one row, over a row's lists, and over all rows of a set, as findings.

Each gives rows of keys, severity, code and detail, one for each broken rule; rules over a set compare by grouped minima and
counts joined back, so a set of any size is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import final_sentence, fingerprint, normalize_key
from quillspark.operators.findings import findings

C = F.col
CHOICE = "array<struct<label:string,text:string>>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD, SENTENCE_END = r"\b[A-Za-z0-9][A-Za-z0-9'-]*\b", r"[.!?](?:\s|$)"
# Stems that ask for less than reasoning, what a question begins with, and lines that name a choice.
SHALLOW = r"(?i)\b(which of the following is true|all except|except)\b"
PROMPT = r"(?i)\b(which|what|who|where|when|why|how)\b"
CHOICE_LINE = r"(?i)^\s*Choice\s+([A-Z])\s*:"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _labels(c: str) -> Column:
    return F.transform(F.coalesce(c, _none(CHOICE)), lambda x: x["label"])


def _sequential(labels: Column) -> Column:
    """Whether labels are A, B, ... in order; an empty list is."""
    return F.coalesce(F.array_join(labels, "", "?") == F.substring(F.lit(LETTERS), F.lit(1), F.size(labels)), F.lit(False))


def details(df: DataFrame, keys: Sequence[str], lists: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """keys, severity, code, detail: a row for each element of each rule's array of details."""

    def labelled(code: str, severity: str, details: Column) -> Column:
        return F.transform(details, lambda x: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), x.cast("string").alias("detail")))

    made = [labelled(*x) for x in lists]
    return df.select(*keys, F.explode(F.concat(*made)).alias("f")).select(*keys, "f.*")


def _repeats(df: DataFrame, key: Column, code: str, first: str) -> DataFrame:
    """A finding for each row of a set whose key an earlier row (by `first`) has; detail: the earliest one."""
    keyed = df.select("set_id", "position", key.alias("key")).where("key IS NOT NULL AND key <> ''")
    seen = keyed.groupBy("set_id", "key").agg(F.min("position").alias(first), F.count("*").alias("n")).where("n > 1")
    return keyed.join(seen, ["set_id", "key"]).where(C("position") > C(first)).select("set_id", "position", F.lit("error").alias("severity"), F.lit(code).alias("code"), C(first).cast("string").alias("detail"))


def _overused(df: DataFrame, key: Column, code: str, severity: str, most: int) -> DataFrame:
    """A finding for each key of a set in more than `most` rows; position is null, detail: the key."""
    keyed = df.select("set_id", key.alias("key")).where("key <> ''")
    often = keyed.groupBy("set_id", "key").agg(F.count("*").alias("n")).where(C("n") > most)
    return often.select("set_id", F.lit(None).cast("long").alias("position"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), C("key").alias("detail"))


def set_findings(questions: DataFrame, organic: bool = False) -> DataFrame:
    """set_id, position, severity, code, detail.

    questions: set_id, position (from 1), number, stem, choices (label, text), correct, objective, explanation (an array of
    lines), target, ranged (whether the set's profile allows 2 to 9 choices instead of A to D). organic makes a short stem
    and an overused target warnings instead of errors. Nulls are empty; repeated rows break the rule of repeated numbers.
    """
    severity = "warning" if organic else "error"
    stem, labels, ranged = F.coalesce("stem", F.lit("")), _labels("choices"), F.coalesce("ranged", F.lit(False))
    final = final_sentence(F.trim(stem))
    words, sentences = F.regexp_count(stem, F.lit(WORD)), F.regexp_count(stem, F.lit(SENTENCE_END))
    n = F.size(F.coalesce("choices", _none(CHOICE)))
    counted = F.when(ranged, n.between(2, 9)).otherwise(n == 4)
    lines = F.coalesce("explanation", _none("array<string>"))
    named = F.filter(F.transform(lines, lambda x: F.upper(F.regexp_extract(x, CHOICE_LINE, 1))), lambda x: x != "")
    rows = questions.withColumns({"position": C("position").cast("long"), "n_": n})
    one = findings(rows, ["set_id", "position"], [
        ("NUMBER", "error", ~F.equal_null(C("number").cast("long"), C("position"))),
        ("MISSING_STEM", "error", F.trim(stem) == ""),
        ("NO_QUESTION", "error", (F.trim(stem) != "") & ~F.coalesce(F.endswith(final, F.lit("?")) & final.rlike(PROMPT), F.lit(False))),
        ("SHORT_STEM", severity, (F.trim(stem) != "") & ((sentences < 2) | (words < 35))),
        ("SHALLOW", "error", stem.rlike(SHALLOW)),
        ("CHOICE_COUNT", "error", ~counted),
        ("LABELS", "error", counted & ~_sequential(labels)),
        ("KEY", "error", ~ranged & ~F.coalesce(C("correct").isin(*"ABCD"), F.lit(False))),
        ("KEY_ABSENT", "error", ~counted | ~F.coalesce(F.array_contains(labels, C("correct")), F.lit(False))),
        ("NO_OBJECTIVE", "error", F.trim(F.coalesce("objective", F.lit(""))) == ""),
        ("NO_SECTIONS", "error", F.size(lines) == 0),
    ]).withColumn("detail", F.lit(None).cast("string"))
    absent = details(rows, ["set_id", "position"], [("ABSENT_CHOICE", "error", F.when(counted & (F.size(labels) > 0), F.filter(named, lambda x: ~F.array_contains(labels, x))).otherwise(_none("array<string>")))])
    prints = F.when(F.trim(stem) != "", fingerprint(stem, F.transform(F.coalesce("choices", _none(CHOICE)), lambda x: F.coalesce(x["text"], F.lit("")))))
    many = [
        _repeats(rows, C("number").cast("string"), "REPEATED_NUMBER", "first"), _repeats(rows, prints, "REPEATED_QUESTION", "first"),
        _overused(rows, normalize_key(F.coalesce("target", F.lit(""))), "TARGET_OVERUSED", severity, 2), _overused(rows, normalize_key(F.coalesce("objective", F.lit(""))), "OBJECTIVE_REPEATED", "error", 1),
    ]
    out = one.unionByName(absent)
    for x in many:
        out = out.unionByName(x)
    return out


REF = "array<struct<id:string,placeholder:string,location:string>>"
IMAGE = "array<struct<figureId:string,dataUrl:string,figureKey:string>>"


def figure_findings(questions: DataFrame) -> DataFrame:
    """set_id, position, severity, code, detail: figures, their references and their placeholders in both directions.

    questions: set_id, position, stem, explanation (a text), has_figure, refs (id, placeholder, location), images and
    explanation_images (figureId, dataUrl, figureKey). Ids and placeholders are unique across the questions of a set; the
    earliest question keeps one. Nulls are empty.
    """
    blank = lambda x: F.coalesce(x, F.lit(""))
    rows = questions.select(
        "set_id", C("position").cast("long").alias("position"), blank(C("stem")).alias("stem"), blank(C("explanation")).alias("explanation"), F.coalesce("has_figure", F.lit(False)).alias("has_figure"),
        F.coalesce("refs", _none(REF)).alias("refs"), F.coalesce("images", _none(IMAGE)).alias("images"), F.coalesce("explanation_images", _none(IMAGE)).alias("others"),
    )
    ids = lambda c, f: F.filter(F.transform(c, lambda x: blank(x[f])), lambda x: x != "")
    refs, stems, others = ids("refs", "id"), ids("images", "figureId"), ids("others", "figureId")
    both = F.concat_ws(" ", "stem", "explanation")
    marks = F.transform(F.regexp_extract_all("stem", F.lit(r"\[FIGURE:\s*([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))
    known = F.transform("refs", lambda r: blank(r["placeholder"]))
    pick = lambda c, test, value: F.transform(F.filter(c, test), value)
    sources = F.concat("images", "others")
    missing = lambda x, f: blank(x[f]) == ""
    repeated = lambda c: F.filter(F.array_distinct(F.transform(c, lambda x: blank(x["figureId"]))), lambda k: F.size(F.filter(c, lambda x: blank(x["figureId"]) == k)) > 1)
    found = details(rows, ["set_id", "position"], [
        ("BOTH_PLACEMENTS", "error", F.array_intersect(stems, others)),
        ("IMAGE_WITHOUT_REF", "error", F.array_except(F.array_union(stems, others), refs)),
        ("REF_INCOMPLETE", "error", pick("refs", lambda r: missing(r, "id") | missing(r, "placeholder"), lambda r: blank(r["id"]))),
        ("PLACEHOLDER_ABSENT", "error", pick("refs", lambda r: ~missing(r, "placeholder") & ~F.contains(both, r["placeholder"]), lambda r: r["placeholder"])),
        ("STEM_REF_WITHOUT_IMAGE", "error", pick("refs", lambda r: (blank(r["location"]) == "stem") & ~F.array_contains(stems, blank(r["id"])), lambda r: blank(r["id"]))),
        ("EXPLANATION_REF_WITHOUT_IMAGE", "error", pick("refs", lambda r: (blank(r["location"]) == "explanation") & ~F.array_contains(others, blank(r["id"])), lambda r: blank(r["id"]))),
        ("IMAGE_TWO_SOURCES", "error", pick(sources, lambda x: ~missing(x, "dataUrl") & ~missing(x, "figureKey"), lambda x: blank(x["figureId"]))),
        ("IMAGE_NO_SOURCE", "error", pick(sources, lambda x: missing(x, "dataUrl") & missing(x, "figureKey"), lambda x: blank(x["figureId"]))),
        ("IMAGE_REPEATED", "error", F.concat(repeated("images"), repeated("others"))),
        ("MARK_WITHOUT_REF", "error", F.filter(marks, lambda m: ~F.array_contains(known, F.concat(F.lit("[FIGURE: "), m, F.lit("]"))) & ~F.array_contains(refs, m))),
        ("FLAG_MISSING", "error", F.when((F.size("refs") > 0) & ~C("has_figure"), F.array(F.lit(None).cast("string"))).otherwise(_none("array<string>"))),
    ])
    each = rows.select("set_id", "position", F.explode("refs").alias("r")).select("set_id", "position", "r.id", "r.placeholder")
    shared = [_repeats(each.select("set_id", "position", c).distinct(), C(c), code, "first") for c, code in (("id", "ID_REUSED"), ("placeholder", "PLACEHOLDER_REUSED"))]
    return found.unionByName(shared[0]).unionByName(shared[1])


# Fixed values of the normalised question.
NORMALISED_VERSION = "normalized-question-v1"
REQUIRED = ("schemaVersion", "sourceFile", "sourceQuestionNumber", "questionId", "stem", "choices", "correctAnswer", "educationalObjective", "correctExplanation", "incorrectExplanations", "reviewPearl", "retrievalTag", "tags", "figures", "tables", "warnings", "confidence")
ARRAYS = ("warnings", "tags", "figures", "tables", "incorrectExplanations")
TEXTS = ("stem", "correctExplanation", "educationalObjective", "reviewPearl", "retrievalTag")
FORBIDDEN = ("Here are the extracted questions", "eftab720", "tightenfactor0", "Below is the JSON", "```json", "```")


def normalised_findings(rows: DataFrame, key: str, column: str, version: str = NORMALISED_VERSION) -> DataFrame:
    """Key, severity, code, detail of the JSON object in `column`; version: the schema version that it should have.

    Missing required fields are all that is reported of a row that lacks any. Otherwise: version, integer number, choices
    (an array of objects with label A to F and text), key (a letter A to F or empty), confidence, array fields, entries of
    incorrectExplanations, and forbidden phrases (without regard to case) in texts, tags and explanations. What is no JSON
    object is INVALID. Numbers are integers if JSON writes them so; a null field is there, but of no type.
    """
    v = F.try_parse_json(column)
    at = lambda path: F.try_variant_get("v", path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(at(path)), F.lit("VOID"))
    text = lambda path: F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))
    is_array = lambda path: F.startswith(kind(path), F.lit("ARRAY"))
    df = rows.select(C(key), v.alias("v"), F.json_object_keys(column).alias("keys")).withColumn("keys", F.coalesce("keys", _none("array<string>")))
    is_object = F.startswith(kind("$"), F.lit("OBJECT"))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), "keys")
    whole = is_object & (F.size(missing) == 0)
    entries = lambda path, n=4096: F.when(is_array(path), F.coalesce(F.try_variant_get("v", path, "array<variant>"), _none("array<variant>"))).otherwise(_none("array<variant>"))
    field = lambda x, f: F.try_variant_get(x, f"$.{f}", "string")
    lacks = lambda path, f: F.transform(F.filter(entries(path), lambda x: field(x, f).isNull()), lambda _: F.lit(f"{path[2:]}.{f}"))
    bad_label = F.transform(F.filter(entries("$.choices"), lambda x: field(x, "label").isNotNull() & ~field(x, "label").rlike("^[A-F]$")), lambda x: field(x, "label"))
    one = lambda test, detail: F.when(test, F.array(detail.cast("string"))).otherwise(_none("array<string>"))
    many_texts = F.concat(
        F.transform(F.array(*(F.struct(F.lit(f).alias("f"), text(f"$.{f}").alias("t")) for f in TEXTS)), lambda x: x),
        F.transform(entries("$.tags"), lambda x: F.struct(F.lit("tags").alias("f"), F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")).alias("t"))),
        F.transform(entries("$.incorrectExplanations"), lambda x: F.struct(F.lit("incorrectExplanations").alias("f"), F.coalesce(field(x, "explanation"), F.lit("")).alias("t"))),
    )
    phrases = F.array(*(F.lit(p.lower()) for p in FORBIDDEN))
    forbidden = F.flatten(F.transform(many_texts, lambda x: F.transform(F.filter(phrases, lambda p: F.contains(F.lower(x["t"]), p)), lambda p: F.concat(x["f"], F.lit(": "), p))))
    rules = [
        ("INVALID", one(~F.coalesce(is_object, F.lit(False)), F.lit(None))),
        ("MISSING_FIELD", F.when(is_object, missing).otherwise(_none("array<string>"))),
    ]
    later = [
        ("VERSION", one(text("$.schemaVersion") != version, text("$.schemaVersion"))),
        ("NUMBER_TYPE", one(kind("$.sourceQuestionNumber") != "BIGINT", kind("$.sourceQuestionNumber"))),
        ("CHOICES_TYPE", one(~is_array("$.choices"), kind("$.choices"))),
        ("CHOICE_FIELD", F.concat(lacks("$.choices", "label"), lacks("$.choices", "text"))),
        ("CHOICE_LABEL", bad_label),
        ("KEY", one((kind("$.correctAnswer") != "STRING") | ~text("$.correctAnswer").rlike("^[A-F]?$"), text("$.correctAnswer"))),
        ("CONFIDENCE", one(~text("$.confidence").isin("high", "medium", "low"), text("$.confidence"))),
        ("ARRAY_TYPE", F.filter(F.array(*(F.when(~is_array(f"$.{f}"), F.lit(f)) for f in ARRAYS)), lambda x: x.isNotNull())),
        ("EXPLANATION_FIELD", F.concat(lacks("$.incorrectExplanations", "label"), lacks("$.incorrectExplanations", "explanation"))),
        ("FORBIDDEN_PHRASE", forbidden),
    ]
    rules += [(code, F.when(F.coalesce(whole, F.lit(False)), d).otherwise(_none("array<string>"))) for code, d in later]
    return details(df, [key], [(code, "error", d) for code, d in rules])


def extraction_gates(rows: DataFrame) -> DataFrame:
    """Rows (key columns, stem, choices, correct, confidence) with warnings, blockers, usable and convertible.

    usable: a stem, four choices or more and a correct answer among the labels; low confidence (under 0.55, or none) only
    warns. convertible: 2 to 9 choices with labels A, B, ... in order, and the answer among them. Labels are compared
    without blanks and case. Nulls are empty.
    """
    choices = F.coalesce("choices", _none(CHOICE))
    labels = F.transform(choices, lambda x: F.upper(F.trim(F.coalesce(x["label"], F.lit("")))))
    answer = F.upper(F.trim(F.coalesce("correct", F.lit(""))))
    named = lambda rules: F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in rules)))
    gates = [("missing stem", F.trim(F.coalesce("stem", F.lit(""))) == ""), ("fewer than 4 answer choices", F.size(choices) < 4), ("correct answer not visible or invalid", ~F.array_contains(labels, answer))]
    blocks = [("not 2-9 choices", ~F.size(choices).between(2, 9)), ("labels are not sequential", ~_sequential(labels)), ("correct answer is not among the labels", ~F.array_contains(labels, answer))]
    low = ("low extraction confidence", F.coalesce(C("confidence"), F.lit(0.0)) < 0.55)
    closed = gates[0][1] | gates[1][1] | gates[2][1]
    return rows.select("*", named([*gates, low]).alias("warnings"), named(blocks).alias("blockers"), (~closed).alias("usable")).withColumn("convertible", F.size("blockers") == 0)


SET = "schemaVersion string, testTitle string, questions array<variant>"


def read_question_sets(spark: SparkSession, path: str) -> DataFrame:
    """A row for each question of each app-ready set file: file, position (from 1), question (a variant), figure_refs, attachments, warnings, error.

    A file that cannot be read as such a set is one row with error and without a question; a set without questions one row
    without either. figure_refs: distinct ids (id, figureId or placeholder) in order; attachments: entries of figureRefs, images,
    explanationImages, tables and explanationTables together; warnings: its extractionWarnings.
    """
    raw = spark.read.schema(f"{SET}, broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    raw = raw.withColumn("file", F.input_file_name())
    error = F.when(C("broken").isNotNull(), "unreadable").when(C("questions").isNull(), "no questions array")
    rows = raw.select("file", error.alias("error"), F.posexplode_outer("questions").alias("p", "question"))
    listed = lambda f: F.coalesce(F.try_variant_get("question", f"$.{f}", "array<variant>"), _none("array<variant>"))

    def name(x: Column) -> Column:
        parts = [F.nullif(F.try_variant_get(x, p, "string"), F.lit("")) for p in ("$.id", "$.figureId", "$.placeholder", "$")]
        return F.coalesce(*parts[:3], F.when(~F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), parts[3]))

    attachments = sum((F.size(listed(f)) for f in ("figureRefs", "images", "explanationImages", "tables", "explanationTables")), F.lit(0))
    return rows.select(
        "file", (C("p") + 1).cast("long").alias("position"), "question", F.array_sort(F.array_distinct(F.filter(F.transform(listed("figureRefs"), name), lambda x: x.isNotNull()))).alias("figure_refs"),
        attachments.cast("long").alias("attachments"), F.filter(F.coalesce(F.try_variant_get("question", "$.extractionWarnings", "array<string>"), _none("array<string>")), lambda x: x.isNotNull()).alias("warnings"), "error",
    )
