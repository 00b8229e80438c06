"""Queries of the text layer (T rows) and of row expanders and sets over lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.registry import query

SQUEEZE = r"trim(regexp_replace({}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
KEY = "lower(" + SQUEEZE.format("text") + ")"


@query("T01_normalize_key", f"SELECT doc_id, {KEY} AS k FROM documents")
def t01(t):
    return t("documents").select("doc_id", T.normalize_key(F.col("text")).alias("k"))


@query("T02_slugify", "SELECT p_partkey, CASE WHEN s = '' THEN 'asset' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._') AS s FROM part)")
def t02(t):
    return t("part").select("p_partkey", T.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("T03_clamp_text", f"SELECT doc_id, substr({SQUEEZE.format('text')}, 1, 120) AS s FROM documents")
def t03(t):
    return t("documents").select("doc_id", T.clamp_text(F.col("text"), 120).alias("s"))


NOISE = ((r"[*#$%&]{3}", " "), (r"!!", " "), (r" \| ", " "), (r" +", " "), (r"\n{3,}", "\n\n"))


def _fold(c: str, rules) -> str:
    for p, by in rules:
        c = f"regexp_replace({c}, '{p}', '{by}', 'g')"
    return c.replace("'\n\n'", "chr(10) || chr(10)")


@query("T04_strip_noise", f"SELECT doc_id, {_fold('text', NOISE)} AS s FROM documents")
def t04(t):
    return t("documents").select("doc_id", T.replace_all(F.col("text"), NOISE).alias("s"))


REPAIRS = (("‘|’", "-"), ("•", "-"), (r" ,", ","), (r" \.", "."), (r"([a-z])- ([a-z])", r"\1\2"))


@query("T05_repair_lines", f"SELECT doc_id, {_fold('text', REPAIRS)} AS s FROM documents")
def t05(t):
    return t("documents").select("doc_id", T.replace_all(F.col("text"), [(p, by.replace("\\", "$")) for p, by in REPAIRS]).alias("s"))


@query("T06_clean_tag", f"SELECT doc_id, rtrim(substr({SQUEEZE.format('text')}, 1, 90), ' .;:') AS tag FROM documents")
def t06(t):
    return t("documents").select("doc_id", T.clean_tag(F.col("text")).alias("tag"))


FIRST = r"coalesce(nullif(regexp_extract(text, '^((?s:.)*?[.!?])(\s|$)', 1), ''), substr(text, 1, 200))"


@query("T07_first_sentence", f"SELECT doc_id, {FIRST} AS s FROM documents")
def t07(t):
    return t("documents").select("doc_id", T.first_sentence(F.col("text")).alias("s"))


# DuckDB's upper gives one character for each, and another one for \xdf; letters whose capital is more than one character are listed.
LONG_CAPITALS = "MAP {" + ", ".join(f"'{chr(c)}': '{chr(c).upper()}'" for c in range(0x80, 0x10000) if len(chr(c).upper()) > 1) + "}"


@query("T08_short_tag", f"SELECT doc_id, substr(coalesce({LONG_CAPITALS}[substr(s, 1, 1)], upper(substr(s, 1, 1))) || substr(s, 2), 1, 70) AS tag FROM (SELECT doc_id, regexp_extract(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' '), '(?i)^(the|of|and)\\s+', ''), '^([^.!?]*)', 1) AS s FROM documents)")
def t08(t):
    return t("documents").select("doc_id", T.short_tag(F.col("text"), verbs=r"(?i)^(the|of|and)\s+").alias("tag"))


@query("T09_fallbacks", f"SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN source END), ''), nullif(trim(CASE WHEN doc_id % 3 = 1 THEN '  ' ELSE lang END), ''), nullif(trim({FIRST}), '')) AS tag FROM documents")
def t09(t):
    c = F.col("doc_id") % 3
    return t("documents").select("doc_id", T.fallback(F.when(c == 0, F.col("source")), F.when(c == 1, "  ").otherwise(F.col("lang")), T.first_sentence(F.col("text"))).alias("tag"))


@query("T10_final_sentence", r"SELECT doc_id, s, coalesce(ends_with(s, '?') AND regexp_matches(s, '(?i)(which|what)'), false) AS asks FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\s*\[Figure: [^\]]*\]\s*$', ''), '[^.!?]+[.!?]?'), lambda p: trim(p)), lambda p: p <> '')[-1] AS s FROM documents)")
def t10(t):
    s = T.final_sentence(F.col("text"))
    return t("documents").select("doc_id", s.alias("s"), F.coalesce(F.endswith(s, F.lit("?")) & s.rlike("(?i)(which|what)"), F.lit(False)).alias("asks"))


@query("T11_fingerprint", f"SELECT doc_id, sha256(concat_ws('|', substr(regexp_replace({KEY}, '[0-9]+', '#', 'g'), 1, 500), lang || '|' || source)) AS f FROM documents")
def t11(t):
    return t("documents").select("doc_id", T.fingerprint(F.col("text"), F.array("lang", "source")).alias("f"))


@query("T12_stable_ids", "SELECT p_partkey, sha256(concat_ws('|', p_name, p_brand, p_type, CAST(p_size AS VARCHAR))) AS id FROM part")
def t12(t):
    return t("part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type", "p_size"), 256).alias("id"))


@query("T13_opening_phrase", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:8], ' ') AS phrase, CASE WHEN doc_id % 90 < 13 THEN 'child' WHEN doc_id % 90 < 18 THEN 'adolescent' WHEN doc_id % 90 < 65 THEN 'adult' ELSE 'older adult' END AS age FROM documents")
def t13(t):
    return t("documents").select("doc_id", T.opening_phrase(F.col("text")).alias("phrase"), T.age_group(F.col("doc_id") % 90).alias("age"))


@query("T14_lab_values", "SELECT doc_id, CASE WHEN len(f) >= 2 THEN array_to_string(f, ';') ELSE l END AS v FROM (SELECT doc_id, l, regexp_extract_all(l, '[a-z]+ [0-9.]+ [a-z]+') AS f FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))")
def t14(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.select("doc_id", F.array_join(T.lab_values(F.col("l"), "[a-z]+ [0-9.]+ [a-z]+"), ";").alias("v"))


@query("T15_figure_language", "SELECT doc_id, regexp_matches(text, '(?i)(figure|image|shown|table) ?[0-9]*') AS f FROM documents")
def t15(t):
    return t("documents").select("doc_id", F.col("text").rlike("(?i)(figure|image|shown|table) ?[0-9]*").alias("f"))


@query("T16_thresholds", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(s, '[0-9]+ (day|week|month|year|hour|minute)s?'), regexp_extract_all(s, '[0-9]+ ?- ?[0-9]+')), list_concat(regexp_extract_all(s, 'every [0-9]+ [a-z]+'), regexp_extract_all(s, 'single dose'))))), ';') AS claims FROM (SELECT doc_id, lower(text) AS s FROM documents)")
def t16(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(T.threshold_claims(F.col("text"))), ";").alias("claims"))


@query("T17_claim_terms", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: regexp_matches(w, '(tion|ment|heit)$') OR w IN ('that', 'with')))), ';') AS terms FROM documents")
def t17(t):
    return t("documents").select("doc_id", F.array_join(T.claim_terms(F.col("text"), "tion|ment|heit", ("that", "with")), ";").alias("terms"))


@query("T18_terms", "SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM documents")
def t18(t):
    return t("documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))


@query("T19_marks", r"SELECT doc_id, k, CASE WHEN regexp_matches(l, '[0-9]{1,2}:[0-9]{2}') THEN 1 ELSE 0 END AS timed, CASE WHEN regexp_matches(trim(l), '^#+\s*\S') THEN trim(regexp_replace(trim(l), '^#+', '')) WHEN ends_with(trim(l), ':') AND len(regexp_split_to_array(trim(l), '\s+')) <= 8 THEN rtrim(trim(l), ':') END AS label FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))")
def t19(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("k"), F.when(T.clock_seconds(F.col("l")).isNotNull(), 1).otherwise(0).alias("timed"), T.section_label(F.col("l")).alias("label"))


@query("T20_markdown", "SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def t20(t):
    rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("x", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])))
    return rows.withColumn("cells", cells).select("r_regionkey", T.markdown_table(F.col("cells")).alias("md"))


@query("T21_figure_marks", r"SELECT doc_id, len(regexp_extract_all(text || '[FIGURE: f' || doc_id || ']', '\[FIGURE:\s*([^\]]+)\]', 1)) AS n, (regexp_extract_all(text || '[FIGURE: f' || doc_id || ']', '\[FIGURE:\s*([^\]]+)\]', 1))[1] AS f FROM documents")
def t21(t):
    m = T.figure_marks(F.concat("text", F.lit("[FIGURE: f"), F.col("doc_id").cast("string"), F.lit("]")))
    return t("documents").select("doc_id", F.size(m).cast("long").alias("n"), F.element_at(m, 1).alias("f"))


@query("T22_parse_json", "SELECT event_id, CASE WHEN json_valid(props) THEN 'ok' ELSE 'invalid' END AS state, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def t22(t):
    parsed = F.from_json("props", "k long, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return t("events").select("event_id", F.when(parsed["_corrupt_record"].isNull(), "ok").otherwise("invalid").alias("state"), parsed["k"].alias("k"))


@query("T23_edit_similarity", "SELECT p_partkey, CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END AS sim FROM (SELECT p_partkey, lower(substr(p_name, 1, 100)) AS a, lower(substr(p_type, 1, 100)) AS b FROM part)")
def t23(t):
    return t("part").select("p_partkey", T.edit_similarity(F.col("p_name"), F.col("p_type")).alias("sim"))


@query("T24_scores", "SELECT doc_id, round(v, 6) AS voice, round(0.4 * CAST(lang = 'en' AS INT) + least(0.4, length(text) / 250.0) - greatest(0, (v - 0.4) * 0.5) - CASE WHEN source = 'src1' THEN 1 ELSE 0 END, 6) AS testable FROM (SELECT *, least(1.0, len(regexp_extract_all(lower(text), '(the|and|der|que)')) / (greatest(len(regexp_extract_all(text, '[^ \\n\\t]+')), 1) / 5.0)) AS v FROM documents)")
def t24(t):
    v = T.voice_score(F.col("text"), "(the|and|der|que)")
    return t("documents").select("doc_id", F.round(v, 6).alias("voice"), F.round(T.testability(F.col("lang") == "en", F.length("text"), v, F.col("source") == "src1"), 6).alias("testable"))


@query("T25_text_grade", "SELECT doc_id, CASE WHEN n = 0 THEN 'none' WHEN n < 6 OR j / n > 0.35 THEN 'poor' WHEN j / n > 0.18 THEN 'fair' ELSE 'good' END AS grade FROM (SELECT doc_id, len(w) AS n, CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[^A-Za-z0-9]+$|[#*$%&|~]{2,}'))) AS DOUBLE) AS j FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n\\t]+') AS w FROM documents))")
def t25(t):
    return t("documents").select("doc_id", T.text_grade(F.col("text")).alias("grade"))


KINDS = (("metal", "STEEL|BRASS|COPPER"), ("large", "LARGE|ECONOMY"), ("small", "SMALL"))
KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches({{c}}, '{p}') THEN '{k}'" for k, p in KINDS) + " ELSE 'other' END"


@query("T26_asset_kind", f"SELECT p_partkey, {KIND_SQL.format(c='upper(p_type)')} AS kind FROM part")
def t26(t):
    return t("part").select("p_partkey", T.rule_ladder(F.upper("p_type"), KINDS, "other").alias("kind"))


@query("T27_figure_size", "SELECT p_partkey, CASE WHEN w < 80 OR h < 80 THEN 'ignore' WHEN greatest(w, h) / CAST(least(w, h) AS DOUBLE) > 8 THEN 'ignore' WHEN w >= 200 AND h >= 200 THEN 'high' ELSE 'low' END AS grade FROM (SELECT p_partkey, p_size * 20 AS w, (p_partkey % 30) * 10 AS h FROM part)")
def t27(t):
    return t("part").select("p_partkey", T.size_grade(F.col("p_size") * 20, F.col("p_partkey") % 30 * 10).alias("grade"))


@query("T28_asset_role", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'stem' WHEN p_size < 20 THEN 'explanation' WHEN p_brand LIKE '%1' THEN 'reference' ELSE 'decoration' END AS role FROM part")
def t28(t):
    return t("part").select("p_partkey", F.when(F.col("p_size") < 5, "stem").when(F.col("p_size") < 20, "explanation").when(F.col("p_brand").like("%1"), "reference").otherwise("decoration").alias("role"))


@query("T29_confidence", "SELECT event_id, least(1.0, greatest(0.0, coalesce(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value / 100 AS VARCHAR) END AS DOUBLE), 0.5))) AS c FROM events")
def t29(t):
    return t("events").select("event_id", T.clamp_confidence(F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("value") / 100).cast("string"))).alias("c"))


TAGS = (("articles", r"\b(the|der|les)\b"), ("links", "(and|und)"), ("numbers", "[0-9]{2,}"), ("marks", "[#*$%&]{3}"))
TAG_SQL = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p.replace(chr(92) + 'b', '(^|[^a-z])', 1).replace(chr(92) + 'b', '([^a-z]|$)')}') THEN '{k}' END" for k, p in TAGS)


@query("T30_auto_tags", f"SELECT doc_id, array_to_string(list_filter([{TAG_SQL}], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def t30(t):
    rules = [(k, p.replace(r"\b", "(^|[^a-z])", 1).replace(r"\b", "([^a-z]|$)")) for k, p in TAGS]
    return t("documents").select("doc_id", F.array_join(T.all_labels(F.lower("text"), rules), ",").alias("tags"))


CLASSES = (("shouting", "[A-Z]{4,}!!"), ("marked", "[#*$%&]{3}"), ("columns", " [|] "), ("numeric", "[0-9]{6,}"))


@query("T31_line_class", "SELECT doc_id, k, CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{c}'" for c, p in CLASSES) + " ELSE 'prose' END AS class FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))")
def t31(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("k"), T.rule_ladder(F.col("l"), CLASSES, "prose").alias("class"))


@query("T32_routes", "SELECT doc_id, CASE WHEN s LIKE '%c1%' THEN 'organic' WHEN s LIKE '%c2%' THEN 'extractive' WHEN lang = 'en' THEN 'vision' ELSE 'error' END AS route FROM (SELECT doc_id, lang, replace(source, '-', '_') AS s FROM documents)")
def t32(t):
    s = F.replace(F.col("source"), F.lit("-"), F.lit("_"))
    return t("documents").select("doc_id", F.when(F.contains(s, F.lit("c1")), "organic").when(F.contains(s, F.lit("c2")), "extractive").when(F.col("lang") == "en", "vision").otherwise("error").alias("route"))


@query("T33_failures", "SELECT event_id, CASE WHEN m LIKE '%error%' AND value > 50 THEN 'quota' WHEN m LIKE '%error%' THEN 'network' WHEN m LIKE '%sign%' THEN 'truncation' END AS failure FROM (SELECT *, lower(event_type) AS m FROM events)")
def t33(t):
    m = F.lower("event_type")
    return t("events").select("event_id", F.when(F.contains(m, F.lit("error")) & (F.col("value") > 50), "quota").when(F.contains(m, F.lit("error")), "network").when(F.contains(m, F.lit("sign")), "truncation").alias("failure"))


@query("T34_letter_grade", "SELECT c_custkey, CASE WHEN p >= 90 THEN 'A' WHEN p >= 80 THEN 'B' WHEN p >= 70 THEN 'C' WHEN p >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT c_custkey, c_custkey % 101 AS p FROM customer)")
def t34(t):
    return t("customer").select("c_custkey", T.letter_grade(F.col("c_custkey") % 101).alias("grade"))


@query("T37_absent_labels", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) AS kept, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def t37(t):
    body = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("b"))
    return body.select("l_orderkey", F.size(F.filter("b", lambda x: F.array_contains(F.array(F.lit("A"), F.lit("N")), x))).cast("long").alias("kept"), F.size("b").cast("long").alias("n"))


@query("T39_fact_lines", "SELECT doc_id, len(f) AS n, array_to_string(list_sort(f), '/') AS facts FROM (SELECT doc_id, list_filter(list_transform(list_transform(regexp_split_to_array(text, '\\n| ; |•'), lambda p: trim(regexp_replace(p, '^[ \\t]*([-*]|[0-9]+[.)])[ \\t]*', ''))), lambda p: substr(p, 1, 220)), lambda p: length(p) >= 4)[1:40] AS f FROM documents)")
def t39(t):
    f = T.fact_lines(F.col("text"))
    return t("documents").select("doc_id", F.size(f).cast("long").alias("n"), F.array_join(F.array_sort(f), "/").alias("facts"))


@query("T40_allowed_facts", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')))[1:220], ' ') AS terms FROM documents")
def t40(t):
    return t("documents").select("doc_id", F.array_join(F.slice(F.array_sort(T.tokens(F.col("text"), 3)), 1, 220), " ").alias("terms"))


@query("T41_fact_labels", "SELECT doc_id, label FROM (SELECT doc_id, unnest([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{c}' END" for c, p in CLASSES) + "]) AS label FROM documents) WHERE label IS NOT NULL")
def t41(t):
    return t("documents").select("doc_id", F.explode(T.all_labels(F.col("text"), CLASSES)).alias("label"))


@query("T43_low_content", "SELECT doc_id, length(trim(text)) < 50 OR len(list_filter(l, lambda x: regexp_matches(x, '^[^a-z]*$'))) > 0.6 * len(l) AS low FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)")
def t43(t):
    return t("documents").select("doc_id", T.low_content(F.col("text"), "^[^a-z]*$").alias("low"))


@query("T44_minutes", "SELECT DISTINCT s, printf('%02d:%02d', s // 60, s % 60) AS t FROM (SELECT l_partkey * 7 AS s FROM lineitem)")
def t44(t):
    return t("lineitem").select((F.col("l_partkey") * 7).alias("s")).distinct().select("s", T.minutes_text(F.col("s")).alias("t"))


@query("T45_candidate_score", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.45 * least(1.0, w * h / 8000.0) + 0.3 * l_discount * 10 + 0.25 * l_tax * 10 - CASE WHEN w / h > 8 OR h / w > 8 THEN 0.5 ELSE 0 END, 4) AS score, CASE WHEN w * h > 4000 THEN 'large' ELSE '' END || CASE WHEN l_discount > 0.05 THEN ',dense' ELSE '' END AS reasons FROM (SELECT *, l_quantity * 4 AS w, l_linenumber * 40.0 AS h FROM lineitem)")
def t45(t):
    w, h = F.col("l_quantity") * 4, F.col("l_linenumber") * F.lit(40.0)
    score = 0.45 * F.least(F.lit(1.0), w * h / 8000) + 0.3 * F.col("l_discount") * 10 + 0.25 * F.col("l_tax") * 10 - F.when((w / h > 8) | (h / w > 8), 0.5).otherwise(0.0)
    reasons = F.concat(F.when(w * h > 4000, "large").otherwise(""), F.when(F.col("l_discount") > 0.05, ",dense").otherwise(""))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 4).alias("score"), reasons.alias("reasons"))


LINES = "SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)"


def lines(t):
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l")).select("doc_id", (F.col("p") + 1).cast("long").alias("k"), "l")


@query("S04_transcript_lines", LINES)
def s04(t):
    return lines(t)


@query("S07_fingerprint", "SELECT doc_id, sha256(text) AS digest, strlen(text) AS size FROM documents")
def s07(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("C04_blocks", f"SELECT doc_id, CAST(island AS BIGINT) AS island, min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT doc_id, k, short, sum(CAST(short AS INT)) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM (SELECT doc_id, k, length(l) < 40 AS short FROM ({LINES}))) WHERE NOT short GROUP BY doc_id, island")
def c04(t):
    """Short lines stand for blank ones, which these texts lack."""
    marked = lines(t).withColumn("short", F.length("l") < 40)
    island = marked.withColumn("island", F.sum(F.col("short").cast("int")).over(Window.partitionBy("doc_id").orderBy("k")))
    return island.where("NOT short").groupBy("doc_id", "island").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"))


@query("D01_ordered_distinct", f"SELECT doc_id, k, l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, l ORDER BY k) AS r FROM ({LINES})) WHERE r = 1")
def d01(t):
    return lines(t).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "l").orderBy("k"))).where("r = 1").drop("r")


@query("D02_exact_collapse", f"SELECT doc_id, k, first_doc, first_k FROM (SELECT doc_id, k, first_value(doc_id) OVER w AS first_doc, first_value(k) OVER w AS first_k, length(key) AS n FROM (SELECT doc_id, k, lower({SQUEEZE.format('l')}) AS key FROM ({LINES})) WINDOW w AS (PARTITION BY key ORDER BY doc_id, k)) WHERE n >= 8 AND (doc_id <> first_doc OR k <> first_k)")
def d02(t):
    """The earliest place of each key is a minimum, combined before the shuffle and joined back, so a hot line splits."""
    keyed = lines(t).select("doc_id", "k", T.normalize_key(F.col("l")).alias("key")).where(F.length("key") >= 8)
    hashed = keyed.select("doc_id", "k", F.sha2("key", 256).alias("key"))
    firsts = hashed.groupBy("key").agg(F.min(F.struct("doc_id", "k")).alias("f"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(firsts, "key").where(F.struct("doc_id", "k") != F.col("f")).select("doc_id", "k", F.col("f.doc_id").alias("first_doc"), F.col("f.k").alias("first_k"))


@query("D08_fillers", r"SELECT doc_id, regexp_replace(regexp_replace(text, '\b(the|of|and)\b', '', 'g'), ' +', ' ', 'g') AS s, len(regexp_extract_all(text, '\b(the|of|and)\b')) AS n FROM documents WHERE lang = 'en'")
def d08(t):
    return t("documents").where("lang = 'en'").select("doc_id", T.replace_all(F.col("text"), ((r"\b(the|of|and)\b", ""), (" +", " "))).alias("s"), F.regexp_count("text", F.lit(r"\b(the|of|and)\b")).cast("long").alias("n"))


@query("W08_adjacent_repeats", f"SELECT doc_id, k, l FROM (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM ({LINES})) WHERE p IS NULL OR p <> l")
def w08(t):
    return lines(t).withColumn("p", F.lag("l").over(Window.partitionBy("doc_id").orderBy("k"))).where("p IS NULL OR p <> l").drop("p")
