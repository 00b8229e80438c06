"""Question and draft contracts, media routes, explanation sections and review drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import final_sentence, normalize_key, threshold_claims
from quillspark.operators.contracts import CHOICE, PROMPT, details
from quillspark.operators.findings import findings

C = F.col
SECTION = "array<struct<heading:string,body:array<string>>>"
BUNDLE_VERSION, SEGMENT_VERSION = "shared-normalized-chunk-bundle-v1", "shared-normalized-segment-v1"
CHUNK_TYPES = ("text", "slide", "question", "transcript", "image", "table")
MANIFEST_FIELDS, MANIFEST_VERSION = ("manifestVersion", "jobId", "sourceType", "inputs", "dryRun", "destination"), "batch-import-job-v1"
#: Messages about a whole set that leave nothing to review.
FATAL = ("schemaVersion must be", "sourceFormat must remain", "questions must be a non-empty array")


def _text(c: str | Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _array(c: str, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def question_findings(questions: DataFrame, keys: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Keys, severity, code: number, a stem that ends in a question, exactly four choices with text, the key among their
    labels, sections with text, tag, pearl, and forbidden strings (case counts) anywhere in the question.

    questions: number, stem, choices (label, text), correct, sections (heading, body), tag, pearl. Nulls are empty.
    """
    choices, sections = _array("choices", CHOICE), _array("sections", SECTION)
    final = final_sentence(_text("stem"))
    asks = F.endswith(final, F.lit("?")) & final.rlike(PROMPT)
    labels = F.transform(choices, lambda x: x["label"])
    blank = lambda s: ~F.exists(F.coalesce(s["body"], F.array().cast("array<string>")), lambda b: F.trim(F.coalesce(b, F.lit(""))) != "")
    whole = F.to_json(F.struct("number", "stem", "choices", "correct", "sections", "tag", "pearl"))
    found = F.exists(F.array(*map(F.lit, forbidden)).cast("array<string>"), lambda p: F.contains(whole, p))
    return findings(questions, keys, [
        ("NUMBER", "error", F.coalesce(C("number"), F.lit(0)) == 0),
        ("MISSING_STEM", "error", _text("stem") == ""),
        ("NO_QUESTION", "error", (_text("stem") != "") & ~F.coalesce(asks, F.lit(False))),
        ("CHOICE_COUNT", "error", F.size(choices) != 4),
        ("EMPTY_CHOICE", "error", (F.size(choices) == 4) & F.exists(choices, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) == "")),
        ("KEY", "error", (_text("correct") == "") | ~F.coalesce(F.array_contains(labels, C("correct")), F.lit(False))),
        ("NO_SECTIONS", "error", F.size(sections) == 0),
        ("EMPTY_SECTION", "error", F.exists(sections, blank)),
        ("TAG", "error", _text("tag") == ""), ("PEARL", "error", _text("pearl") == ""), ("FORBIDDEN", "error", found),
    ])


def bundle_findings(bundles: DataFrame, key: str) -> DataFrame:
    """Key, place (of the chunk, from 1; null for the bundle), code.

    bundles: schemaVersion, chunkCount and chunks (chunkId, schemaVersion, chunkType, grounded, imageRefs, tableRefs, warnings,
    textBlocks). Without chunks only that is reported. An id repeats where an earlier chunk of its bundle has it; a null array
    is one that isn't there.
    """
    chunks = C("chunks")
    ids = F.transform(chunks, lambda x: F.coalesce(x["chunkId"], F.lit("")))
    one = lambda test, code: F.when(test, F.lit(code))

    def rules(x: Column, k: Column) -> Column:
        own = F.coalesce(x["chunkId"], F.lit(""))
        lists = [one(x[f].isNull(), f"{f} must be an array") for f in ("imageRefs", "tableRefs", "warnings", "textBlocks")]
        return F.array_compact(F.array(
            one(own == "", "missing chunkId"), one((own != "") & (F.array_position(ids, own) <= k), "repeated chunkId"), one(~F.equal_null(x["schemaVersion"], F.lit(SEGMENT_VERSION)), "chunk schemaVersion"),
            one(~F.coalesce(x["chunkType"].isin(*CHUNK_TYPES), F.lit(False)), "chunkType"), one(~F.coalesce(x["grounded"], F.lit(False)), "sourceGrounding must be an object"), *lists,
        ))

    each = F.flatten(F.transform(chunks, lambda x, k: F.transform(rules(x, k), lambda code: F.struct((k + 1).alias("place"), code.alias("code")))))
    top = F.array(one(~F.equal_null(C("schemaVersion"), F.lit(BUNDLE_VERSION)), "schemaVersion"), one(chunks.isNull(), "chunks must be an array"), one(chunks.isNotNull() & ~F.equal_null(C("chunkCount").cast("long"), F.size(chunks).cast("long")), "chunkCount"))
    whole = F.transform(F.array_compact(top), lambda code: F.struct(F.lit(None).cast("int").alias("place"), code.alias("code")))
    none = F.array().cast("array<struct<place:int,code:string>>")
    return bundles.select(key, F.explode(F.concat(whole, F.coalesce(each, none))).alias("f")).select(key, "f.place", "f.code")


def manifest_findings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Key, code of the JSON manifests in `column`: missing fields alone if there are any, else version, inputs and typed flags; what is no object is INVALID."""
    v = F.try_parse_json(column)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    df = rows.select(key, v.alias("v"), F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")).alias("keys"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, MANIFEST_FIELDS)), "keys"), lambda x: F.concat(F.lit("missing "), x))
    has = lambda f: F.array_contains("keys", f)
    inputs = F.startswith(kind("$.inputs"), F.lit("ARRAY")) & F.try_variant_get("v", "$.inputs[0]", "variant").isNotNull()
    rest = F.array_compact(F.array(
        F.when(~F.equal_null(F.try_variant_get("v", "$.manifestVersion", "string"), F.lit(MANIFEST_VERSION)), "unsupported manifestVersion"), F.when(~inputs, "inputs must be a non-empty array"),
        *(F.when(has(f) & (kind(f"$.{f}") != t), f"{f} must be {t.lower()}") for f, t in (("requiresGemini", "BOOLEAN"), ("existingOutputValidation", "BOOLEAN"), ("outputRoot", "STRING"))),
    ))
    is_object = F.startswith(kind("$"), F.lit("OBJECT"))
    found = F.when(~is_object, F.array(F.lit("INVALID"))).when(F.size(missing) > 0, missing).otherwise(rest)
    return df.select(key, F.explode(found).alias("code"))


def draft_findings(drafts: DataFrame, key: str) -> DataFrame:
    """Key, severity, code of refined drafts (stem, choices, correct, point, rationales by label): five choices A to E in order with text, stem of 20 and point of 8 characters or more, a rationale for each label."""
    choices = _array("choices", CHOICE)
    letter = lambda x: F.upper(_text(x))
    given = F.coalesce("rationales", F.create_map().cast("map<string,string>"))
    lacking = F.filter(F.array(*map(F.lit, "ABCDE")), lambda k: _text(F.element_at(given, k)) == "")
    return findings(drafts, [key], [
        ("CHOICE_COUNT", "error", F.size(choices) != 5),
        ("LABELS", "error", (F.size(choices) == 5) & (F.array_join(F.transform(choices, lambda x: letter(x["label"])), "") != "ABCDE")),
        ("EMPTY_CHOICE", "error", F.exists(choices, lambda x: _text(x["text"]) == "")),
        ("SHORT_STEM", "error", F.char_length(_text("stem")) < 20), ("SHORT_POINT", "error", F.char_length(_text("point")) < 8),
        ("KEY", "error", ~letter(C("correct")).isin(*"ABCDE")), ("RATIONALE", "error", F.size(lacking) > 0),
    ])


def asset_reasons(references: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Bundle, reasons (distinct, sorted) why what it refers to can't be used again; bundles without a reason are left out.

    references: bundle, path, sha256 (null or blank: not known); files: path, sha256, one row each. A path outside root is
    that alone; else one that is no file is missing, and one with another hash has changed. Null and blank paths refer to nothing.
    """
    refs = references.select("bundle", _text("path").alias("path"), _text("sha256").alias("expected")).where("path <> ''").distinct()
    outside = ~F.startswith("path", F.lit(root.rstrip("/") + "/")) | C("path").rlike(r"(^|/)\.\.(/|$)")
    known = files.groupBy("path").agg(F.max("sha256").alias("found"))
    joined = refs.join(known, "path", "left")
    reason = F.when(outside, "normalized_asset_outside_job_root").when(C("found").isNull(), "normalized_asset_missing").when((C("expected") != "") & (C("expected") != C("found")), "normalized_asset_hash_mismatch")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("bundle").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


#: Where an image goes by its kind, if its route doesn't say.
PLACEMENT = {"diagnostic": "stem", "explanatory": "explanation", "algorithm": "explanation", "table-like": "explanation"}


def media_routes(questions: DataFrame, images: DataFrame, by_kind: bool = False) -> DataFrame:
    """Questions with stem (placeholders appended where absent), stem_figures, explanation_figures, refs and error.

    questions: set_id, position (together unique), source_id, stem, routes (imageId, placement); images: source_id, image_id,
    kind, unique by the first two. A route to an image that the source lacks, or with a placement other than stem or
    explanation, is dropped; with by_kind one without a placement goes where its kind does. An image routed to both is an
    error, and the question then has no figures. Figures keep the order of routes; repeated ones count once.
    """
    keys = ["set_id", "position"]
    spread = questions.select(*keys, "source_id", F.posexplode("routes").alias("at", "r")).select(*keys, "source_id", "at", _text(C("r.imageId")).alias("image_id"), F.lower(_text(C("r.placement"))).alias("said"))
    joined = spread.join(images.select("source_id", "image_id", "kind"), ["source_id", "image_id"])
    default = F.coalesce(F.create_map(*[F.lit(x) for kv in PLACEMENT.items() for x in kv])[C("kind")], F.lit("ignored")) if by_kind else F.lit("ignored")
    placed = joined.withColumn("placement", F.when(C("said") == "", default).otherwise(C("said"))).where("placement IN ('stem', 'explanation')")
    one = placed.groupBy(*keys, "image_id").agg(F.min("at").alias("at"), F.min("placement").alias("placement"), F.count_distinct("placement").alias("places"))
    found = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "image_id", "placement"))).alias("f"), F.array_sort(F.collect_set(F.when(C("places") > 1, C("image_id")))).alias("both"))
    out = questions.join(found, keys, "left")
    bad = F.size(F.coalesce("both", F.array().cast("array<string>"))) > 0
    figures = F.when(~bad, F.coalesce("f", F.array().cast("array<struct<at:int,image_id:string,placement:string>>"))).otherwise(F.array().cast("array<struct<at:int,image_id:string,placement:string>>"))
    mark = lambda x: F.concat(F.lit("[FIGURE: "), x["image_id"], F.lit("]"))
    of = lambda p: F.transform(F.filter("figures", lambda x: x["placement"] == p), lambda x: x["image_id"])
    stem = F.coalesce("stem", F.lit(""))
    missing = F.filter(F.transform(F.filter("figures", lambda x: x["placement"] == "stem"), mark), lambda m: ~F.contains(stem, m))
    refs = F.transform("figures", lambda x: F.struct(x["image_id"].alias("id"), mark(x).alias("placeholder"), x["placement"].alias("location")))
    return out.withColumn("figures", figures).select(
        *keys, F.concat_ws(" ", F.nullif(stem, F.lit("")), F.nullif(F.array_join(missing, " "), F.lit(""))).alias("stem"), of("stem").alias("stem_figures"), of("explanation").alias("explanation_figures"), refs.alias("refs"),
        F.when(bad, F.concat(F.lit("routed to both stem and explanation: "), F.array_join("both", ", "))).alias("error"),
    )


def explanation_sections(correct: Column, incorrect: Column, objective: Column, figures: Column, by_choice: bool = True) -> Column:
    """Ordered sections (heading, body), empty ones left out. incorrect: an array of (label, explanation); its lines are `Choice X: text`, or `x. text`; entries without label or text are left out."""
    rows = F.filter(F.transform(F.coalesce(incorrect, F.array().cast("array<struct<label:string,explanation:string>>")), lambda x: F.struct(F.upper(_text(x["label"])).alias("k"), _text(x["explanation"]).alias("t"))), lambda x: (x["k"] != "") & (x["t"] != ""))
    lines = F.transform(rows, lambda x: F.concat(F.lit("Choice "), x["k"], F.lit(": "), x["t"]) if by_choice else F.concat(x["k"], F.lit(". "), x["t"]))
    text = lambda c: F.filter(F.array(_text(c)), lambda x: x != "")
    parts = [("Correct Answer Explanation", text(correct)), ("Incorrect Answer Explanation", lines), ("Slide Figures", F.coalesce(figures, F.array().cast("array<string>"))), ("Educational Objective", text(objective))]
    return F.filter(F.array(*(F.struct(F.lit(h).alias("heading"), b.alias("body")) for h, b in parts)), lambda s: F.size(s["body"]) > 0)


def review_drafts(questions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts (set_id, n_questions, n_errors, valid) and their items (set_id, kind, severity, position, message).

    questions: set_id, position; messages: set_id, kind (error, warning, semantic or quality), position (null: of the whole
    set), message. A set has a draft if it has an error, none of which begins like FATAL, and a question that no error names.
    valid: positions that no error names, sorted. Errors are items of severity error, the other kinds of warning. Sets without
    questions have none.
    """
    errors = messages.where("kind = 'error'")
    fatal = F.exists(F.array(*map(F.lit, FATAL)), lambda p: F.contains("message", p))
    sets = errors.groupBy("set_id").agg(F.count("*").alias("n_errors"), F.max(F.coalesce(fatal, F.lit(False))).alias("fatal")).where("NOT fatal")
    named = errors.where("position IS NOT NULL").select("set_id", "position").distinct()
    own = questions.select("set_id", "position").distinct()
    sound = own.join(named, ["set_id", "position"], "left_anti").groupBy("set_id").agg(F.array_sort(F.collect_list("position")).alias("valid"))
    counts = own.groupBy("set_id").agg(F.count("*").alias("n_questions"))
    drafts = sets.join(sound, "set_id").join(counts, "set_id").select("set_id", "n_questions", "n_errors", "valid")
    items = messages.join(drafts.select("set_id"), "set_id", "left_semi").select("set_id", "kind", F.when(C("kind") == "error", "error").otherwise("warning").alias("severity"), "position", "message")
    return drafts, items


# What a learner leaves on a question and a redo takes away.
LEARNER_FIELDS = tuple("hint hints generatedHint aiHint hintHtml hintShown hintUsed selectedAnswer userAnswer isCorrect flagged confidence notes scratch elapsedTime timeSpent answeredAt reviewedAt markedForReview".split())


def reset_for_redo(questions: DataFrame, fields: Sequence[str] = LEARNER_FIELDS, column: str | None = None) -> DataFrame:
    """Questions without learner state: top-level columns, or fields of the struct in `column`; names that aren't there are passed over."""
    if column is None:
        return questions.drop(*(f for f in fields if f in questions.columns))
    there = [f for f in fields if f in questions.schema[column].dataType.names]
    return questions.withColumn(column, C(column).dropFields(*there)) if there else questions


QUALITIES, DISPOSITIONS, IMAGE_KINDS = ("none", "poor", "fair", "good"), ("keep", "merge", "suppress", "recap_only", "low_information"), ("diagnostic", "explanatory", "algorithm", "decorative", "table-like")
CONCEPT_FIELDS = (
    "conceptId", "sourceSlideIds", "title", "category", "clinicalFacts", "diagnosticFacts", "managementFacts", "mechanismFacts", "differentialFacts", "trapFacts", "nativeTextFacts", "imageOcrFacts", "cleanedImageFacts", "structuredImageFacts",
    "imageTextQuality", "images", "tables", "questionPotential", "groundingTerms", "semanticClusterId", "duplicateOf", "overlapScore", "dedupeDisposition",
)


def concept_findings(rows: DataFrame, deck: str, column: str) -> DataFrame:
    """Deck, position, code, detail of concepts as JSON in `column`, with position (from 1) in their deck.

    Missing keys, a missing or repeated id (an earlier position has it), an empty title, no source slides, fact lists, images,
    tables and terms that are no lists, structured facts that are no object, values outside the enumerations, an overlap that
    is no number or outside 0 to 1, and kinds of images. What is no object is that alone.
    """
    v = F.try_parse_json(column)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))
    text = lambda path: F.coalesce(F.try_variant_get("v", path, "string"), F.lit(""))
    df = rows.select(C(deck), C("position").cast("long").alias("position"), v.alias("v"), F.coalesce(F.json_object_keys(column), F.array().cast("array<string>")).alias("keys")).withColumn("id", text("$.conceptId"))
    lists = [f for f in CONCEPT_FIELDS if (f.endswith("Facts") and f != "structuredImageFacts") or f in ("images", "tables", "groundingTerms")]
    one = lambda test, detail=None: F.when(F.coalesce(test, F.lit(True)), F.array(F.lit(detail).cast("string") if detail is None or isinstance(detail, str) else detail)).otherwise(F.array().cast("array<string>"))
    is_object = F.startswith(kind("$"), F.lit("OBJECT"))
    score = F.try_variant_get("v", "$.overlapScore", "double")
    images = F.coalesce(F.try_variant_get("v", "$.images", "array<variant>"), F.array().cast("array<variant>"))
    slides = F.startswith(kind("$.sourceSlideIds"), F.lit("ARRAY")) & F.try_variant_get("v", "$.sourceSlideIds[0]", "variant").isNotNull()
    bad_kinds = F.filter(F.transform(F.filter(images, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), lambda x: F.coalesce(F.try_variant_get(x, "$.kind", "string"), F.lit(""))), lambda k: ~k.isin(*IMAGE_KINDS))
    rules = [
        ("missing key", F.array_except(F.array(*map(F.lit, CONCEPT_FIELDS)), "keys")), ("missing conceptId", one(C("id") == "")), ("empty title", one(text("$.title") == "")), ("no source slides", one(~slides)),
        ("not a list", F.filter(F.array(*(F.when(~F.startswith(kind(f"$.{f}"), F.lit("ARRAY")), F.lit(f)) for f in lists)), lambda x: x.isNotNull())), ("structured facts", one(~F.startswith(kind("$.structuredImageFacts"), F.lit("OBJECT")))),
        ("image text quality", one(~text("$.imageTextQuality").isin(*QUALITIES), text("$.imageTextQuality"))), ("disposition", one(~text("$.dedupeDisposition").isin(*DISPOSITIONS), text("$.dedupeDisposition"))),
        ("overlap is no number", one(score.isNull())), ("overlap outside 0 to 1", one(F.coalesce(~score.between(0, 1), F.lit(False)))), ("image kind", bad_kinds),
    ]
    none = F.array().cast("array<string>")
    made = [F.transform(F.when(is_object, d).otherwise(none), _coded(code)) for code, d in rules]
    made.append(F.transform(F.when(F.coalesce(is_object, F.lit(False)), none).otherwise(F.array(F.lit(None).cast("string"))), _coded("not an object")))
    own = df.select(deck, "position", F.explode(F.concat(*made)).alias("f")).select(deck, "position", "f.*")
    ids = df.where("id <> ''").select(deck, "position", "id")
    first = ids.groupBy(deck, "id").agg(F.min("position").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.join(first, [deck, "id"]).where("position > first").select(deck, "position", F.lit("repeated conceptId").alias("code"), C("id").alias("detail"))
    return own.unionByName(again)


def _coded(code: str):
    return lambda x: F.struct(F.lit(code).alias("code"), x.cast("string").alias("detail"))


def placement_findings(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, severity, code of rows with kind, images and explanation_images (arrays of ids): a stem image has one image in the
    stem and none in the explanation, an explanation or table image none and one; no image stands in both; other kinds are unknown."""
    ids = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    stem, explanation = ids("images"), ids("explanation_images")
    placed = F.struct(F.size(stem).alias("a"), F.size(explanation).alias("b"))
    wanted = F.when(C("kind") == "stem_image", F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"))).when(C("kind").isin("explanation_image", "table_image"), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return findings(rows, keys, [("KIND", "error", wanted.isNull()), ("PLACEMENT", "error", wanted.isNotNull() & (placed != wanted)), ("BOTH_PLACEMENTS", "error", F.arrays_overlap(stem, explanation))])


# Stems that order events in an awkward way, and the archetypes in which a choice may not stand in the stem.
AWKWARD, NO_ECHO = r"(?i)medication initiation|was prescribed .* several days after", ("diagnosis", "adverse_effect")


def strict_findings(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """set_id, position, code, detail: thresholds that the source lacks, choices of other classes than the first, choices of two or more words in the stem, awkward stems.

    questions: set_id, position, source_id, stem, choices (label, text), classes (of the choices, in order; null: not told),
    claims (an array of texts), archetype; sources: source_id, text, one row each. A question whose source isn't there has
    no findings. Thresholds are those of T16, in choices and claims; comparison is on normalised texts. Nulls are empty.
    """
    texts = F.transform(_array("choices", CHOICE), lambda x: F.coalesce(x["text"], F.lit("")))
    said = F.array_join(F.concat(texts, F.filter(_array("claims", "array<string>"), lambda x: x.isNotNull())), " ")
    rows = questions.select("set_id", "position", "source_id", F.coalesce("stem", F.lit("")).alias("stem"), texts.alias("texts"), threshold_claims(said).alias("thresholds"), _array("classes", "array<string>").alias("classes"), _text("archetype").alias("archetype"))
    joined = rows.join(sources.select("source_id", normalize_key(F.coalesce("text", F.lit(""))).alias("known")), "source_id")
    key = normalize_key(C("stem"))
    unsupported = F.filter("thresholds", lambda x: ~F.contains(C("known"), x))
    mixed = F.filter("classes", lambda x: ~F.equal_null(x, F.get("classes", F.lit(0))))
    echoed = F.filter("texts", lambda x: (F.size(F.split(normalize_key(x), " ")) >= 2) & F.contains(key, normalize_key(x)))
    none = F.array().cast("array<string>")
    lists = [
        ("unsupported_threshold", "error", unsupported), ("mixed_choice_classes", "error", F.array_distinct(mixed)), ("choice_in_stem", "error", F.when(F.lower("archetype").isin(*NO_ECHO), echoed).otherwise(none)),
        ("awkward_stem", "error", F.when(C("stem").rlike(AWKWARD), F.array("stem")).otherwise(none)),
    ]
    return details(joined, ["set_id", "position"], lists).drop("severity")
