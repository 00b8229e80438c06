"""Queries of parsing, packing, box and allocation operators on views of documents, pages and conversations (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import allocation, boxes, consolidate, contracts, drafts, markup, packers, question_text, salvage, shared_options, wrapped
from quillspark.plans.registry import query
from quillspark.plans.text_queries import LINES, lines

C = F.col


def noisy_json(t):
    """A record of each document as JSON, in one of eight states of damage by doc_id."""
    record = F.to_json(F.struct("doc_id", "lang", "text"))
    cut = F.substring(record, F.lit(1), (F.char_length(record) * 3 / 5).cast("int"))
    kinds = [
        record, F.concat(F.lit("```json\n"), record, F.lit("\n```")), F.concat(F.lit('Here is "it: '), record, F.lit(" as asked [1")), F.concat(F.lit("{\"rows\": ["), record, F.lit(",],}")),
        cut, F.translate(record, '"', "“"), F.concat(F.lit("[{\"doc_id\": }, "), record, F.lit("]")), F.concat(record, F.lit(" "), record),
    ]
    damaged = F.lit("")
    for k, c in enumerate(kinds):
        damaged = F.when(C("doc_id") % 9 == k, c).otherwise(damaged)
    return t("documents").select("doc_id", damaged.alias("noisy"))


@query("T22_salvage_json")
def t22_salvage(t):
    """State and recovered document of each damaged record."""
    found = salvage.salvage_json(noisy_json(t), "doc_id", "noisy", "doc_id")
    return found.select(C("id").alias("doc_id"), "state", F.get_json_object("json", "$.doc_id").cast("long").alias("found_id"), F.char_length("json").cast("long").alias("n_chars"), F.sha2("json", 256).alias("json_sha256"))


@query("V06_markup_audit")
def v06(t):
    return markup.markup_findings(t("pages"))


_ENDS = "|".join((*wrapped.AT_END, *wrapped.LAST_WORDS))
_NORMAL = r"trim(regexp_replace(l, '[ \t\r\f\v]+', ' ', 'g'), ' -•' || chr(9))"
_JOINS = f"""(list_contains([{", ".join(f"'{w}'" for w in wrapped.ALONE)}], trim(lower(f.cur), ':')) OR lower(f.cur) = '{wrapped.WHOLE[0]}'
 OR (len(regexp_extract_all(f.cur, '[\\p{{L}}\\p{{N}}_]+')) <= 2 AND regexp_matches(lower(r.l), '^({"|".join(wrapped.AT_START)})([^\\p{{L}}\\p{{N}}_]|$)'))
 OR regexp_matches(lower(f.cur), '(^|[^\\p{{L}}\\p{{N}}_])({_ENDS})$')
 OR (len(regexp_extract_all(f.cur, '[\\p{{L}}\\p{{N}}_]+')) <= 5 AND len(regexp_extract_all(r.l, '[\\p{{L}}\\p{{N}}_]+')) <= 2 AND NOT ends_with(r.l, ':')))"""


@query("C13_joined_lines", f"""WITH RECURSIVE raw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, l FROM (SELECT doc_id, k, {_NORMAL} AS l FROM ({LINES})) WHERE l <> ''),
f AS (SELECT doc_id, i, l AS cur, CAST(1 AS BIGINT) AS k FROM raw WHERE i = 1 UNION ALL
 SELECT r.doc_id, r.i, CASE WHEN {_JOINS} THEN f.cur || ' ' || r.l ELSE r.l END, CASE WHEN {_JOINS} THEN f.k ELSE f.k + 1 END FROM f JOIN raw r ON r.doc_id = f.doc_id AND r.i = f.i + 1)
SELECT doc_id, k, arg_max(cur, i) AS line FROM f GROUP BY doc_id, k""")
def c13(t):
    return wrapped.unwrap(t("documents"))


def items(t):
    """A user turn is an item; the first four sentences of the next turn are its options, which items after the first of every third conversation lack."""
    turns = t("conversations").select("conv_id", "turn", "role", "text")
    after = turns.where("role = 'assistant'").select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("answer"))
    binds = C("conv_id") % 3 == 0
    head = F.when(binds & (C("turn") < 2), F.array(F.lit("The response options for the next 4 items are the same."), F.lit("For each case, select one option."))).otherwise(F.array().cast("array<string>"))
    pieces = F.slice(F.filter(F.split("answer", r"\. "), lambda p: F.trim(p) != ""), 1, 4)
    options = F.transform(pieces, lambda p, k: F.concat(F.substring(F.lit("ABCD"), k + 1, F.lit(1)), F.lit(") "), F.trim(F.regexp_replace(p, r"\s+", " "))))
    options = F.when(binds & (C("turn") >= 2) | C("answer").isNull(), F.array().cast("array<string>")).otherwise(options)
    stem = F.array(F.concat((C("turn") + 1).cast("string"), F.lit(". "), F.regexp_replace("text", r"\s+", " ")))
    made = turns.where("role = 'user'").join(after, ["conv_id", "turn"], "left")
    return made.select(C("conv_id").alias("set_id"), (C("turn") + 1).alias("number"), F.concat(head, options, stem).alias("lines"))


@query("C11_shared_options", r"""WITH u AS (SELECT c.conv_id AS set_id, c.turn + 1 AS number, c.turn, regexp_replace(c.text, '\s+', ' ', 'g') AS stem, c.conv_id % 3 = 0 AS binds, list_filter(string_split(a.text, '. '), lambda p: trim(p) <> '')[1:4] AS p
 FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user'),
o AS (SELECT *, CASE WHEN (binds AND turn >= 2) OR p IS NULL THEN [] ELSE list_transform(p, lambda x, i: substr('ABCD', CAST(i AS INT), 1) || '=' || trim(regexp_replace(x, '\s+', ' ', 'g'))) END AS own FROM u),
g AS (SELECT set_id, number AS range_start, least(number + 3, (SELECT max(number) FROM o b WHERE b.set_id = o.set_id)) AS e, own AS bank FROM o WHERE binds AND turn < 2 AND len(own) > 0),
h AS (SELECT set_id, range_start, least(e, coalesce(lead(range_start) OVER (PARTITION BY set_id ORDER BY range_start) - 1, e)) AS range_end, bank FROM g),
j AS (SELECT o.*, h.range_start, h.range_end, h.bank, h.bank IS NOT NULL AND (len(own) = 0 OR own = h.bank) AS grouped FROM o LEFT JOIN h ON h.set_id = o.set_id AND o.number BETWEEN h.range_start AND h.range_end)
SELECT set_id, number, trim(stem) AS stem, array_to_string(CASE WHEN len(own) = 0 AND grouped THEN bank ELSE own END, '|') AS options, CASE WHEN len(own) > 0 THEN 'own' WHEN grouped THEN 'group' ELSE 'none' END AS source,
 grouped, CASE WHEN grouped THEN range_start END AS range_start, CASE WHEN grouped THEN range_end END AS range_end, CASE WHEN grouped OR (binds AND turn < 2 AND len(own) > 0) THEN 'For each case, select one option.' END AS shared FROM j""")
def c11(t):
    found = shared_options.grouped(items(t))
    return found.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("="), o["text"])), "|")).withColumn("stem", F.trim("stem"))


def blocks(t, size):
    """doc_id, block (from 0), lines: consecutive lines of each document."""
    cut = F.split("text", "\n")
    made = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / size).cast("int")), lambda k: F.slice("x", k * size + 1, F.lit(size)))
    return t("documents").where("text IS NOT NULL").select("doc_id", cut.alias("x")).select("doc_id", F.posexplode(made).alias("block", "lines"))


def doc_pages(t):
    """Six lines are a page, and paragraphs of it; every third page has a figure."""
    page = (C("block") + 1).cast("long")
    figures = F.when(page % 3 == 0, F.array(F.concat(F.lit("f"), page.cast("string")))).otherwise(F.array().cast("array<string>"))
    return blocks(t, 6).select("doc_id", page.alias("page"), F.array_join("lines", "\n\n").alias("text"), figures.alias("figures"))


@query("C02_page_chunks")
def c02(t):
    """Digests instead of the chunks' texts."""
    packed = packers.pack_pages(doc_pages(t), 3000)
    return packed.select("doc_id", "chunk", "page_start", "page_end", C("n_chars").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), F.array_join("figures", ",").alias("figures"))


_COST = "900 + least(coalesce(length(text), 0), 3200) * 2.2 + (n_chars % 4) * 160 + (n_chars % 3) * 700"


@query("C06_cost_batches", f"""WITH RECURSIVE x AS (SELECT source, doc_id, CAST(floor({_COST}) AS DOUBLE) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, cost, i, CAST(1 AS BIGINT) AS batch, 1 AS n, cost AS total FROM x WHERE i = 1 UNION ALL
 SELECT x.source, x.doc_id, x.cost, x.i, CASE WHEN f.n >= 3 OR f.total + x.cost > 6500 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 3 OR f.total + x.cost > 6500 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 3 OR f.total + x.cost > 6500 THEN x.cost ELSE f.total + x.cost END
 FROM f JOIN x ON x.source = f.source AND x.i = f.i + 1)
SELECT source, doc_id, cost, batch FROM f""")
def c06(t):
    cost = F.floor(900 + F.least(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(3200)) * 2.2 + (C("n_chars") % 4) * 160 + (C("n_chars") % 3) * 700)
    made = t("documents").select("source", C("doc_id").alias("position"), cost.cast("double").alias("cost"))
    return packers.cost_batches(made).select("source", C("position").alias("doc_id"), "cost", "batch")


_HEX = "CAST('0x' || substr(md5(l), {}, 6) AS BIGINT)"
LINE_BOXES = f"""SELECT doc_id AS page, k AS box, x0, y0, x0 + w AS x1, y0 + h AS y1, a % 100 / 100.0 AS score, b % 100 / 100.0 AS visual, c % 100 / 100.0 AS textual FROM (
 SELECT *, (a % 7) * 100 AS x0, (b % 10) * 100 AS y0, 60 + (c % 5) * 40 AS w, 40 + (a // 7 % 4) * 50 AS h FROM (SELECT doc_id, k, {_HEX.format(1)} AS a, {_HEX.format(7)} AS b, {_HEX.format(13)} AS c FROM ({LINES}) WHERE l <> ''))"""


def line_boxes(t):
    """A box for each line that is not empty, by its hash: equal lines of a page lie on each other."""
    a, b, c = (F.conv(F.substring(F.md5("l"), k, 6), 16, 10).cast("long") for k in (1, 7, 13))
    parts = lines(t).where("l <> ''").select("doc_id", "k", a.alias("a"), b.alias("b"), c.alias("c"))
    x0, y0, w, h = (C("a") % 7) * 100, (C("b") % 10) * 100, (C("c") % 5) * 40 + 60, (F.floor(C("a") / 7) % 4) * 50 + 40
    return parts.select(C("doc_id").alias("page"), C("k").alias("box"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + h).alias("y1"), *((C(p) % 100 / 100).alias(n) for p, n in (("a", "score"), ("b", "visual"), ("c", "textual"))))


_BOTH = "(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))".format(a="e", b="r")


@query("J20_suppressed_boxes", f"""WITH RECURSIVE q AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, round(score + 0.28 * visual - 0.20 * textual + CASE WHEN (x1 - x0) * (y1 - y0) < 900000 THEN 0.035 ELSE 0 END, 9) AS quality FROM ({LINE_BOXES})),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY quality DESC, visual DESC, textual, area, box) AS i FROM q),
f AS (SELECT page, i, box, CAST(NULL AS BIGINT) AS suppressed_by, [{{'box': box, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area, 'quality': quality}}] AS stay FROM r WHERE i = 1 UNION ALL
 SELECT page, i, box, hit, CASE WHEN hit IS NULL THEN list_append(stay, me) ELSE stay END FROM (
  SELECT r.page, r.i, r.box, f.stay, {{'box': r.box, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'area': r.area, 'quality': r.quality}} AS me,
   list_filter(f.stay, lambda e: {_BOTH} > 0 AND ({_BOTH} / (e.area + r.area - {_BOTH}) >= 0.58 OR ({_BOTH} / r.area >= 0.90 AND r.area <= e.area AND r.quality <= e.quality + 0.08)
    OR ({_BOTH} / e.area >= 0.94 AND r.area > e.area * 1.18 AND r.quality <= e.quality + 0.12)))[1].box AS hit FROM f JOIN r ON r.page = f.page AND r.i = f.i + 1))
SELECT page, box, suppressed_by IS NULL AS kept, suppressed_by FROM f""")
def j20_suppressed(t):
    return boxes.suppress(line_boxes(t)).select("page", "box", "kept", "suppressed_by")


@query("J21_merged_boxes")
def j21(t):
    return boxes.merge(line_boxes(t), 12, 900, 1300)


_KEYS = "list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')), lambda w: {'n': -length(w), 'w': w}))[1:5], lambda s: s.w)"
SLIDES = f"""SELECT source, doc_id AS position, n_chars % 101 AS potential, len(string_split(text, chr(10))) % 20 AS richness, n_chars % 5 AS categories,
 CASE n_chars % 6 WHEN 0 THEN 'IMAGE_HEAVY' WHEN 1 THEN 'HIGH_YIELD_CLINICAL' WHEN 2 THEN 'MECHANISM' WHEN 3 THEN 'TABLE_HEAVY' WHEN 4 THEN 'ADMINISTRATIVE' ELSE 'OTHER' END AS kind, {_KEYS} AS keys FROM documents"""


def slides(t):
    """Documents of a source, in order; the five longest words are keys."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    longest = F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 5)
    kinds = F.array(*map(F.lit, ("IMAGE_HEAVY", "HIGH_YIELD_CLINICAL", "MECHANISM", "TABLE_HEAVY", "ADMINISTRATIVE", "OTHER")))
    return t("documents").select(
        "source", C("doc_id").alias("position"), (C("n_chars") % 101).alias("potential"), (F.size(F.split("text", "\n")) % 20).alias("richness"), (C("n_chars") % 5).alias("categories"),
        F.array(F.get(kinds, (C("n_chars") % 6).cast("int"))).alias("types"), F.transform(longest, lambda s: s["w"]).alias("keys"),
    )


_RED = "greatest(x.prior, CASE WHEN len(x.keys) > 0 THEN len(list_filter(x.keys, lambda w: list_contains(f.taken, w))) / CAST(len(x.keys) AS DOUBLE) ELSE 0 END)"


@query("W04_allocation", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS i FROM ({SLIDES})),
often AS (SELECT source, key FROM (SELECT source, unnest(keys) AS key FROM s) GROUP BY source, key HAVING count(*) > 1),
shares AS (SELECT e.source, e.position, count(o.key) / CAST(count(*) AS DOUBLE) AS prior FROM (SELECT source, position, unnest(keys) AS key FROM s) e LEFT JOIN often o ON o.source = e.source AND o.key = e.key GROUP BY 1, 2),
x AS (SELECT s.*, coalesce(shares.prior, 0) AS prior FROM s LEFT JOIN shares USING (source, position)),
f AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS position, 0 AS n, 0.0::DOUBLE AS redundancy, CAST([] AS VARCHAR[]) AS taken FROM (SELECT DISTINCT source FROM x) UNION ALL
 SELECT source, i, position, n, redundancy, CASE WHEN n > 0 THEN list_concat(taken, keys) ELSE taken END FROM (
  SELECT x.source, x.i, x.position, x.keys, f.taken, {_RED} AS redundancy, CASE WHEN kind = 'ADMINISTRATIVE' THEN 0
   WHEN potential >= 85 AND richness >= 12 AND categories >= 2 AND {_RED} < 0.35 AND kind IN ('HIGH_YIELD_CLINICAL', 'MECHANISM') THEN 2
   WHEN potential >= 50 AND richness >= 3 AND {_RED} < 0.8 THEN 1 WHEN kind IN ('IMAGE_HEAVY', 'TABLE_HEAVY') AND potential >= 40 AND {_RED} < 0.85 THEN 1 ELSE 0 END AS n FROM f JOIN x ON x.source = f.source AND x.i = f.i + 1))
SELECT source, position, CAST(n AS BIGINT) AS count, round(redundancy, 3) AS redundancy FROM f WHERE i > 0""")
def w04_allocation(t):
    return allocation.allocate(slides(t)).select("source", "position", "count", "redundancy")


def concepts(t):
    """Three lines of a document are a concept of its deck: a title and facts; numbers are a structured list, every fourth concept has an asset."""
    digits = F.regexp_extract_all(F.array_join("lines", " "), F.lit("[0-9]{3,}"), F.lit(0))
    return blocks(t, 3).select(C("doc_id").alias("deck"), C("block").cast("long").alias("concept"), F.get("lines", 0).alias("title"), F.slice("lines", 2, 2).alias("facts"), F.create_map(F.lit("numbers"), digits).alias("structured"), (C("block") % 4 == 3).cast("int").alias("assets"))


@query("D05_greedy_consolidation")
def d05_greedy(t):
    return consolidate.consolidate(concepts(t))


@query("J07_four_part_overlaps")
def j07_four_parts(t):
    pairs, _ = consolidate.overlaps(concepts(t))
    return pairs.select("deck", "a", "b", "score", F.array_join("reasons", "; ").alias("reasons"))


def _choices(answer, n):
    """The first n sentences of a text as choices A, B, ..."""
    pieces = F.slice(F.filter(F.split(answer, r"\. "), lambda p: F.trim(p) != ""), 1, n)
    return F.transform(pieces, lambda p, k: F.struct(F.substring(F.lit("ABCDEF"), k + 1, F.lit(1)).alias("label"), F.trim(F.regexp_replace(p, r"\s+", " ")).alias("text")))


def questions(t):
    """A user turn is a question of its conversation; the next turn gives choices, objective and explanation, and by turn and id some are at fault."""
    turns = t("conversations").select("conv_id", "turn", "role", "text")
    after = turns.where("role = 'assistant'").select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("answer"))
    made = turns.where("role = 'user'").join(after, ["conv_id", "turn"], "left")
    k, position = (C("conv_id") + C("turn")) % 7, F.floor(C("turn") / 2) + 1
    stem = F.when(k == 0, C("text")).when(k == 1, F.lit("")).otherwise(F.concat("text", F.lit(" Which of these fits best?")))
    return made.select(
        C("conv_id").alias("set_id"), position.cast("long").alias("position"), F.when(k == 2, position + 1).otherwise(position).cast("long").alias("number"), stem.alias("stem"), _choices("answer", F.when(k == 3, 3).otherwise(4)).alias("choices"),
        F.when(k == 4, "E").otherwise(F.substring(F.lit("ABCD"), (C("conv_id") % 4 + 1).cast("int"), F.lit(1))).alias("correct"), F.when(k == 5, F.lit(None)).otherwise(F.concat(F.lit("goal "), (C("turn") % 3).cast("string"))).alias("objective"),
        F.when(k != 6, F.array(F.lit("Choice A: yes"), F.lit("choice f: no"), F.lit("plain"))).alias("explanation"), F.lit("one target").alias("target"), (C("conv_id") % 2 == 1).alias("ranged"),
    )


QUESTIONS = r"""SELECT c.conv_id AS set_id, c.turn // 2 + 1 AS position, CASE WHEN k = 2 THEN c.turn // 2 + 2 ELSE c.turn // 2 + 1 END AS number, CASE k WHEN 0 THEN c.text WHEN 1 THEN '' ELSE c.text || ' Which of these fits best?' END AS stem,
 list_transform(coalesce(list_filter(string_split(a.text, '. '), lambda p: trim(p) <> ''), [])[1:CASE WHEN k = 3 THEN 3 ELSE 4 END], lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) AS texts,
 CASE WHEN k = 4 THEN 'E' ELSE substr('ABCD', CAST(c.conv_id % 4 + 1 AS INT), 1) END AS correct, CASE WHEN k <> 5 THEN 'goal ' || (c.turn % 3) END AS objective, k <> 6 AS sections, c.conv_id % 2 = 1 AS ranged
 FROM (SELECT *, (conv_id + turn) % 7 AS k FROM conversations WHERE role = 'user') c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'"""


@query("V04_set_contract", rf"""WITH q AS (SELECT *, len(texts) AS n, CASE WHEN ranged THEN len(texts) BETWEEN 2 AND 9 ELSE len(texts) = 4 END AS counted, list_contains(string_split('ABCDEF', '')[1:len(texts)], correct) AS inside FROM ({QUESTIONS})),
f AS (SELECT set_id, position, unnest(list_filter([CASE WHEN number <> position THEN 'NUMBER' END, CASE WHEN trim(stem) = '' THEN 'MISSING_STEM' END, CASE WHEN trim(stem) <> '' AND NOT ends_with(stem, ' Which of these fits best?') THEN 'NO_QUESTION' END,
 CASE WHEN trim(stem) <> '' AND (len(regexp_extract_all(stem, '[.!?](\s|$)')) < 2 OR len(regexp_extract_all(regexp_replace(stem, '([A-Za-z0-9_]*([^\x00-\x7F]|_))+[A-Za-z0-9_]*', '?', 'g'), '[A-Za-z0-9][A-Za-z0-9''-]*')) < 35) THEN 'SHORT_STEM' END, CASE WHEN regexp_matches(stem, '(?i)\b(which of the following is true|all except|except)\b') THEN 'SHALLOW' END,
 CASE WHEN NOT counted THEN 'CHOICE_COUNT' END, CASE WHEN NOT ranged AND correct = 'E' THEN 'KEY' END, CASE WHEN NOT counted OR NOT inside THEN 'KEY_ABSENT' END, CASE WHEN objective IS NULL THEN 'NO_OBJECTIVE' END, CASE WHEN NOT sections THEN 'NO_SECTIONS' END,
 CASE WHEN counted AND sections THEN 'ABSENT_CHOICE' END], lambda x: x IS NOT NULL)) AS code FROM q),
s AS (SELECT *, substr(regexp_replace(lower(trim(regexp_replace(stem, '[ \t\n\r\f\v]+', ' ', 'g'))), '[0-9]+', '#', 'g'), 1, 500) || '|' || array_to_string(list_transform(texts, lambda x: lower(x)), '|') AS key FROM q)
SELECT set_id, position, 'error' AS severity, code, CASE WHEN code = 'ABSENT_CHOICE' THEN 'F' END AS detail FROM f
UNION ALL SELECT set_id, position, 'error', 'REPEATED_NUMBER', CAST(first AS VARCHAR) FROM (SELECT set_id, position, min(position) OVER (PARTITION BY set_id, number) AS first FROM q) WHERE position > first
UNION ALL SELECT set_id, position, 'error', 'REPEATED_QUESTION', CAST(first AS VARCHAR) FROM (SELECT set_id, position, min(position) OVER (PARTITION BY set_id, key) AS first FROM s WHERE trim(stem) <> '') WHERE position > first
UNION ALL SELECT set_id, NULL, 'error', 'TARGET_OVERUSED', 'one target' FROM q GROUP BY set_id HAVING count(*) > 2
UNION ALL SELECT set_id, NULL, 'error', 'OBJECTIVE_REPEATED', objective FROM q WHERE objective IS NOT NULL GROUP BY set_id, objective HAVING count(*) > 1""")
def v04(t):
    return contracts.set_findings(questions(t))


def figured(t):
    """Two documents in three have a figure; by doc_id its marks, references and images are at fault."""
    k, d = C("doc_id") % 11, C("doc_id")
    fig = F.concat(F.lit("f"), F.when(k == 9, d - 9 + 1000).otherwise(d + 1000).cast("string"))
    mark = F.concat(F.lit("[FIGURE: "), fig, F.lit("]"))
    ref = F.struct(F.when(k != 1, fig).alias("id"), F.when(k != 2, mark).alias("placeholder"), F.when(k == 3, "explanation").otherwise("stem").alias("location"))
    image = F.struct(fig.alias("figureId"), F.when(k != 4, "data:").alias("dataUrl"), F.when(k == 5, "key").alias("figureKey"))
    has = d % 3 < 2
    return t("documents").select(
        F.floor(d / 1000).alias("set_id"), d.alias("position"), F.when(has & (k != 6), F.concat("text", F.lit(" "), mark)).otherwise(C("text")).alias("stem"), F.lit(None).cast("string").alias("explanation"), (has & (k != 7)).alias("has_figure"),
        F.when(has & (k != 8), F.array(ref)).alias("refs"), F.when(has, F.when(k == 10, F.array(image, image)).otherwise(F.array(image))).alias("images"), F.when(has & (k == 0), F.array(image)).alias("explanation_images"),
    )


@query("V07_figure_contract", """WITH d AS (SELECT doc_id, doc_id // 1000 AS set_id, doc_id % 11 AS k, 'f' || (CASE WHEN doc_id % 11 = 9 THEN doc_id - 9 ELSE doc_id END + 1000) AS fig FROM documents WHERE doc_id % 3 < 2 AND text IS NOT NULL),
x AS (SELECT *, '[FIGURE: ' || fig || ']' AS mark FROM d),
own AS (SELECT a.set_id, a.doc_id, a.fig, min(b.doc_id) AS first FROM d a JOIN d b ON b.set_id = a.set_id AND b.fig = a.fig AND b.k NOT IN (1, 8) WHERE a.k NOT IN (1, 8) GROUP BY 1, 2, 3),
ph AS (SELECT a.set_id, a.doc_id, min(b.doc_id) AS first FROM d a JOIN d b ON b.set_id = a.set_id AND b.fig = a.fig AND b.k NOT IN (2, 8) WHERE a.k NOT IN (2, 8) GROUP BY 1, 2)
SELECT set_id, doc_id AS position, 'error' AS severity, code, detail FROM (
 SELECT set_id, doc_id, 'BOTH_PLACEMENTS' AS code, fig AS detail FROM x WHERE k = 0 UNION ALL SELECT set_id, doc_id, 'IMAGE_WITHOUT_REF', fig FROM x WHERE k IN (1, 8)
 UNION ALL SELECT set_id, doc_id, 'REF_INCOMPLETE', CASE WHEN k = 1 THEN '' ELSE fig END FROM x WHERE k IN (1, 2) UNION ALL SELECT set_id, doc_id, 'PLACEHOLDER_ABSENT', mark FROM x WHERE k = 6
 UNION ALL SELECT set_id, doc_id, 'STEM_REF_WITHOUT_IMAGE', '' FROM x WHERE k = 1 UNION ALL SELECT set_id, doc_id, 'EXPLANATION_REF_WITHOUT_IMAGE', fig FROM x WHERE k = 3
 UNION ALL SELECT set_id, doc_id, 'IMAGE_TWO_SOURCES', fig FROM x WHERE k = 5 UNION ALL SELECT set_id, doc_id, 'IMAGE_NO_SOURCE', fig FROM x WHERE k = 4 UNION ALL SELECT set_id, doc_id, 'IMAGE_REPEATED', fig FROM x WHERE k = 10
 UNION ALL SELECT set_id, doc_id, 'MARK_WITHOUT_REF', fig FROM x WHERE k = 8 UNION ALL SELECT set_id, doc_id, 'FLAG_MISSING', NULL FROM x WHERE k = 7
 UNION ALL SELECT set_id, doc_id, 'ID_REUSED', CAST(first AS VARCHAR) FROM own WHERE doc_id > first UNION ALL SELECT set_id, doc_id, 'PLACEHOLDER_REUSED', CAST(first AS VARCHAR) FROM ph WHERE doc_id > first)""")
def v07(t):
    """Documents without a text are no questions."""
    return contracts.figure_findings(figured(t).where("stem IS NOT NULL"))


def normalised(t):
    """A document as a normalised question in JSON; by doc_id a field is missing or wrong."""
    k, d = C("doc_id") % 13, C("doc_id").cast("string")
    q = lambda s: F.to_json(F.struct(s.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(s.alias("v")))) - 6)
    text = q(F.coalesce("text", F.lit("")))
    fields = {
        "schemaVersion": F.when(k == 1, '"v0"').otherwise('"normalized-question-v1"'), "sourceFile": F.lit('"f"'), "sourceQuestionNumber": F.when(k == 2, F.concat(F.lit('"'), d, F.lit('"'))).otherwise(d), "questionId": F.concat(F.lit('"q'), d, F.lit('"')),
        "stem": text, "choices": F.when(k == 3, '[{"label":"G","text":"x"},{"label":"A"}]').when(k == 4, "{}").otherwise('[{"label":"A","text":"x"}]'), "correctAnswer": F.when(k == 5, '"G"').when(k == 6, '""').otherwise('"A"'), "educationalObjective": F.lit('"o"'),
        "correctExplanation": F.when(k == 7, '"see ```JSON x"').otherwise('"c"'), "incorrectExplanations": F.when(k == 8, '[{"label":"B"}]').otherwise("[]"), "reviewPearl": F.lit('"p"'), "retrievalTag": F.lit('"t"'), "tags": F.when(k == 9, '"t"').otherwise('["t"]'),
        "figures": F.lit("[]"), "tables": F.lit("[]"), "warnings": F.lit("[]"), "confidence": F.when(k == 10, '"sure"').otherwise('"high"'),
    }
    parts = [F.when(~((k == 11) & F.lit(f in ("tags", "stem"))), F.concat(F.lit(f'"{f}":'), c)) for f, c in fields.items()]
    made = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.when(k == 12, "").otherwise("}"))
    return t("documents").select("doc_id", made.alias("json"))


@query("V03_normalised_contract", """SELECT doc_id, 'error' AS severity, code, detail FROM (SELECT doc_id, unnest(CASE doc_id % 13 WHEN 1 THEN [{'code': 'VERSION', 'detail': 'v0'}] WHEN 2 THEN [{'code': 'NUMBER_TYPE', 'detail': 'STRING'}]
 WHEN 3 THEN [{'code': 'CHOICE_FIELD', 'detail': 'choices.text'}, {'code': 'CHOICE_LABEL', 'detail': 'G'}] WHEN 4 THEN [{'code': 'CHOICES_TYPE', 'detail': 'OBJECT<>'}] WHEN 5 THEN [{'code': 'KEY', 'detail': 'G'}]
 WHEN 7 THEN [{'code': 'FORBIDDEN_PHRASE', 'detail': 'correctExplanation: ```json'}, {'code': 'FORBIDDEN_PHRASE', 'detail': 'correctExplanation: ```'}] WHEN 8 THEN [{'code': 'EXPLANATION_FIELD', 'detail': 'incorrectExplanations.explanation'}]
 WHEN 9 THEN [{'code': 'ARRAY_TYPE', 'detail': 'tags'}] WHEN 10 THEN [{'code': 'CONFIDENCE', 'detail': 'sure'}] WHEN 11 THEN [{'code': 'MISSING_FIELD', 'detail': 'stem'}, {'code': 'MISSING_FIELD', 'detail': 'tags'}] WHEN 12 THEN [{'code': 'INVALID', 'detail': NULL}] ELSE [] END, recursive := true) FROM documents)""")
def v03(t):
    return contracts.normalised_findings(normalised(t), "doc_id", "json")


@query("V14_extraction_gates", rf"""SELECT set_id, position, array_to_string(list_filter([CASE WHEN trim(stem) = '' THEN 'missing stem' END, CASE WHEN n < 4 THEN 'fewer than 4 answer choices' END, CASE WHEN NOT inside THEN 'correct answer not visible or invalid' END, CASE WHEN low THEN 'low extraction confidence' END], lambda x: x IS NOT NULL), '; ') AS warnings,
 array_to_string(list_filter([CASE WHEN n NOT BETWEEN 2 AND 9 THEN 'not 2-9 choices' END, CASE WHEN NOT inside THEN 'correct answer is not among the labels' END], lambda x: x IS NOT NULL), '; ') AS blockers, trim(stem) <> '' AND n >= 4 AND inside AS usable, n BETWEEN 2 AND 9 AND inside AS convertible
 FROM (SELECT *, len(texts) AS n, list_contains(string_split('ABCDEF', '')[1:len(texts)], correct) AS inside, position % 3 = 0 AS low FROM ({QUESTIONS}))""")
def v14(t):
    rows = questions(t).withColumn("confidence", F.when(C("position") % 3 == 0, 0.5).otherwise(0.55))
    found = contracts.extraction_gates(rows)
    return found.select("set_id", "position", *(F.array_join(c, "; ").alias(c) for c in ("warnings", "blockers")), "usable", "convertible")


def exam_text(t):
    """Every fourth line of a document begins an item, the others are its options; every fifth item says its key."""
    marked = F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 4 == 0, F.concat((F.floor(k / 4) + 1).cast("string"), F.lit(". "), x)).otherwise(F.concat(F.substring(F.lit("ABC"), (k % 4).cast("int"), F.lit(1)), F.lit(") "), x)))
    keyed = F.transform(marked, lambda x, k: F.when(k % 20 == 3, F.concat(x, F.lit("\nCorrect answer: B because of it"))).otherwise(x))
    return t("documents").select("doc_id", F.array_join(keyed, "\n").alias("text"))


@query("C03_question_chunks")
def c03(t):
    """Warnings and digests of the chunks of all documents."""
    chunks, _ = question_text.question_chunks(exam_text(t))
    return chunks.select("doc_id", "position", "number", "confidence", F.array_join("warnings", "; ").alias("warnings"), F.sha2("text", 256).alias("text_sha256"))


@query("C10_answer_keys")
def c10(t):
    found = question_text.answer_keys(exam_text(t))
    return found.select("doc_id", "number", "correct", "found_by", F.array_join(F.array_sort(F.map_keys("explanations")), ",").alias("explained"))


@query("C01_note_chunks")
def c01_notes(t):
    """Lines are paragraphs here, as these texts have no blank ones."""
    docs = t("documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return question_text.chunk_notes(docs).select("doc_id", "chunk", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("C14_atomic_lines")
def c14(t):
    """A document's lines in one block, its last line as notes, and its first three lines as a table of words."""
    cut = F.split("text", "\n")
    table = F.struct(F.slice(F.split(F.get(cut, 0), " "), 1, 3).alias("headers"), F.transform(F.slice(cut, 2, 2), lambda x: F.split(x, " ")).alias("rows"))
    slides = t("documents").where("text IS NOT NULL").select(C("doc_id").alias("slide_id"), F.array("text").alias("blocks"), F.element_at(cut, -1).alias("notes"), F.array(table).alias("tables"))
    return wrapped.atomic_lines(slides).select(C("slide_id").alias("doc_id"), "k", "line")


def messages(t):
    """A message of each document's own words, in which by doc_id a phrase of a failure stands."""
    phrases = ["HTTP 429 from", "rate limit", "urlopen error", "Network is unreachable", "truncation_missing_closing_bracket", "Truncation_missing_closing_bracket", "quota exceeded, repair_timeout"]
    said = F.get(F.array(*map(F.lit, phrases)), (C("doc_id") % 11).cast("int"))
    return t("documents").select("doc_id", F.concat_ws(" ", F.lit("failed:"), F.substring(F.sha2("text", 256), 1, 12), said).alias("message"))


@query("T33_failure_classes", """SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'quota' WHEN 1 THEN 'quota' WHEN 2 THEN 'network' WHEN 3 THEN 'network' WHEN 4 THEN 'truncation' WHEN 6 THEN 'network,quota' ELSE '' END AS classes FROM documents""")
def t33(t):
    return messages(t).select("doc_id", F.array_join(T.failure_classes(C("message")), ",").alias("classes"))


@query("V02_question_rules", rf"""SELECT set_id, position, 'error' AS severity, unnest(list_filter([CASE WHEN trim(stem) = '' THEN 'MISSING_STEM' END, CASE WHEN trim(stem) <> '' AND NOT ends_with(stem, ' Which of these fits best?') THEN 'NO_QUESTION' END, CASE WHEN n <> 4 THEN 'CHOICE_COUNT' END,
 CASE WHEN NOT list_contains(string_split('ABCDEF', '')[1:n], correct) THEN 'KEY' END, CASE WHEN NOT sections THEN 'NO_SECTIONS' END, CASE WHEN objective IS NULL THEN 'PEARL' END, CASE WHEN contains(array_to_string(texts, ' '), 'moron') OR contains(stem, 'moron') THEN 'FORBIDDEN' END], lambda x: x IS NOT NULL)) AS code
 FROM (SELECT *, len(texts) AS n FROM ({QUESTIONS}))""")
def v02_rules(t):
    sections = F.when(C("explanation").isNotNull(), F.array(F.struct(F.lit("why").alias("heading"), C("explanation").alias("body"))))
    rows = questions(t).withColumns({"sections": sections, "tag": C("target"), "pearl": C("objective")})
    return drafts.question_findings(rows, ["set_id", "position"], ["moron"])


def bundles(t):
    """A document is a bundle of chunks of six lines; by doc_id it is at fault."""
    k = C("doc_id") % 8
    cut = blocks(t, 6).select("doc_id", "block")
    none = F.array().cast("array<string>")
    chunk = F.struct(
        F.when(k == 1, "x").otherwise(F.concat(F.lit("c"), C("block").cast("string"))).alias("chunkId"), F.lit(drafts.SEGMENT_VERSION).alias("schemaVersion"), F.when(k == 4, "song").otherwise("text").alias("chunkType"), (k != 7).alias("grounded"),
        F.when(k != 5, none).alias("imageRefs"), none.alias("tableRefs"), none.alias("warnings"), none.alias("textBlocks"),
    )
    whole = cut.select("doc_id", F.struct("block", chunk.alias("c")).alias("x")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["c"]).alias("chunks"))
    return whole.select("doc_id", F.when(k == 3, "v0").otherwise(drafts.BUNDLE_VERSION).alias("schemaVersion"), (F.size("chunks") + F.when(k == 2, 1).otherwise(0)).alias("chunkCount"), F.when(k != 6, C("chunks")).alias("chunks"))


@query("V01_bundle_rules", """WITH b AS (SELECT doc_id, doc_id % 8 AS k, CAST(ceil(len(string_split(text, chr(10))) / 6.0) AS INT) AS n FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, k, unnest(range(1, n + 1)) AS place FROM b)
SELECT doc_id, CAST(NULL AS BIGINT) AS place, CASE k WHEN 2 THEN 'chunkCount' WHEN 3 THEN 'schemaVersion' ELSE 'chunks must be an array' END AS code FROM b WHERE k IN (2, 3, 6)
UNION ALL SELECT doc_id, place, CASE k WHEN 1 THEN 'repeated chunkId' WHEN 4 THEN 'chunkType' WHEN 5 THEN 'imageRefs must be an array' ELSE 'sourceGrounding must be an object' END FROM c WHERE k IN (4, 5, 7) OR (k = 1 AND place > 1)""")
def v01_rules(t):
    return drafts.bundle_findings(bundles(t), "doc_id").withColumn("place", C("place").cast("long"))
