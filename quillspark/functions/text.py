"""Column expressions for study text: normalising, classifying and extracting. No user-defined functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """White space runs become one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def normalize_key(c: Column) -> Column:
    """T01."""
    return F.lower(squeeze(c))


def slugify(c: Column, default: str = "asset") -> Column:
    """Runs outside [A-Za-z0-9._-] become _, repeated _ one; ends lose . and _; empty gives the default."""
    s = F.btrim(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "_+", "_"), F.lit("._"))
    return F.when(s == "", default).otherwise(s)


def clamp_text(c: Column, n: int) -> Column:
    """T03."""
    return F.substring(squeeze(c), 1, n)


def replace_all(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered replacements."""
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def first_sentence(c: Column, fallback: int = 200) -> Column:
    """Up to the first of .!? before white space or the end, else the first characters."""
    found = F.regexp_extract(c, r"^(?s)(.*?[.!?])(\s|$)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(c, 1, fallback))


def clean_tag(c: Column, n: int = 90) -> Column:
    """At most n characters, without trailing blanks, dots, colons or semicolons."""
    return F.rtrim(F.substring(squeeze(c), 1, n), F.lit(" .;:"))


def short_tag(c: Column, n: int = 70, verbs: str = "(?i)^(understand|know|recognize|identify|review)\\s+") -> Column:
    """Without a leading learning verb, capitalised, cut at a sentence's end or n characters."""
    s = F.regexp_replace(squeeze(c), verbs, "")
    s = F.regexp_extract(s, r"^([^.!?]*)", 1)
    return F.substring(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**30)), 1, n)


def fallback(*columns: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def final_sentence(c: Column) -> Column:
    """The last non-blank piece that ends in .!? or the end, a trailing [Figure: ...] aside."""
    cut = F.regexp_replace(c, r"\s*\[Figure: [^\]]*\]\s*$", "")
    pieces = F.filter(F.transform(F.regexp_extract_all(cut, F.lit(r"[^.!?]+[.!?]?"), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    return F.try_element_at(pieces, F.lit(-1))


def fingerprint(stem: Column, choices: Column, n: int = 500) -> Column:
    """Hash of the normalised stem, numbers as #, and the choices; the whole digest."""
    key = F.substring(F.regexp_replace(normalize_key(stem), r"[0-9]+", "#"), 1, n)
    return F.sha2(F.concat_ws("|", key, F.array_join(F.transform(choices, normalize_key), "|")), 256)


def opening_phrase(c: Column, n: int = 8) -> Column:
    """T13."""
    return F.array_join(F.slice(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), 1, n), " ")


def age_group(age: Column) -> Column:
    """T13."""
    return F.when(age < 13, "child").when(age < 18, "adolescent").when(age < 65, "adult").when(age >= 65, "older adult").otherwise("unspecified")


def lab_values(c: Column, pattern: str = r"[A-Za-z]+ [0-9]+(\.[0-9]+)? [A-Za-z/%]+") -> Column:
    """The values of a line that has two or more, else the line."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) >= 2, found).otherwise(F.array(c))


def threshold_claims(c: Column) -> Column:
    """Durations, ranges, `every N units` and `single dose`; normalised and distinct."""
    patterns = (r"[0-9]+ (day|week|month|year|hour|minute)s?", r"[0-9]+ ?- ?[0-9]+", r"every [0-9]+ [a-z]+", "single dose")
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(0)) for p in patterns])))


def claim_terms(c: Column, suffixes: str, known: Sequence[str]) -> Column:
    """Words of four letters and more with one of the suffixes, or known; distinct and sorted."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(f"({suffixes})$") | w.isin(*known))))


def tokens(c: Column, least: int = 4) -> Column:
    """Distinct lower-case words of letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{%d,}" % least), F.lit(0)))


def cloze_terms(c: Column) -> Column:
    """T19."""
    return F.regexp_extract_all(c, F.lit(r"\{\{c[0-9]+::(.*?)(::.*?)?\}\}"), F.lit(1))


def clock_seconds(c: Column) -> Column:
    """The first m:ss or h:mm:ss, in seconds; null without one."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, r"(?:([0-9]+):)?([0-9]{1,2}):([0-9]{2})", k), F.lit("")).cast("int"), F.lit(0))
    return F.when(c.rlike(r"[0-9]{1,2}:[0-9]{2}"), part(1) * 3600 + part(2) * 60 + part(3))


def section_label(c: Column) -> Column:
    """A # heading, or a line of at most 8 words that ends in a colon; else null."""
    line = F.trim(c)
    return F.when(line.rlike(r"^#+\s*\S"), F.trim(F.regexp_replace(line, "^#+", ""))).when(F.endswith(line, F.lit(":")) & (F.size(F.split(line, r"\s+")) <= 8), F.rtrim(line, F.lit(":")))


def markdown_table(rows: Column) -> Column:
    """Array of rows of cells; a rule row follows the first."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), "\n", " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.element_at(rows, 1), lambda x: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.element_at(rows, 1))), F.array(rule), F.transform(F.slice(rows, 2, 2**30), line)), "\n")


def figure_marks(c: Column) -> Column:
    """T21."""
    return F.regexp_extract_all(c, F.lit(r"\[FIGURE:\s*([^\]]+)\]"), F.lit(1))


def edit_similarity(a: Column, b: Column, n: int = 100) -> Column:
    """Of the first n normalised characters; 1 if both are empty."""
    x, y = F.substring(normalize_key(a), 1, n), F.substring(normalize_key(b), 1, n)
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def voice_score(c: Column, phrases: str) -> Column:
    """Phrase hits for each five words, at most 1."""
    return F.least(F.lit(1.0), F.size(F.regexp_extract_all(F.lower(c), F.lit(phrases), F.lit(0))) / (F.greatest(F.size(F.regexp_extract_all(c, F.lit(r"[^ \n\t]+"), F.lit(0))), F.lit(1)) / 5))


def testability(typed: Column, length: Column, voice: Column, meta: Column) -> Column:
    """T24."""
    return 0.40 * typed.cast("int") + F.least(F.lit(0.40), length / 250) - F.greatest(F.lit(0.0), (voice - 0.40) * 0.5) - F.when(meta, 1.0).otherwise(0.0)


def text_grade(c: Column) -> Column:
    """Share of tokens without letters or digits, or broken by other signs."""
    words = F.regexp_extract_all(c, F.lit(r"[^ \n\t]+"), F.lit(0))
    junk = F.size(F.filter(words, lambda w: w.rlike(r"^[^A-Za-z0-9]+$|[#*$%&|~]{2,}")))
    n = F.size(words)
    return F.when(n == 0, "none").when((n < 6) | (junk / n > 0.35), "poor").when(junk / n > 0.18, "fair").otherwise("good")


def rule_ladder(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (label, pattern) that the text matches."""
    out = None
    for label, pattern in rules:
        out = (F.when if out is None else out.when)(c.rlike(pattern), label)
    return out.otherwise(default)


def all_labels(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The labels of all rules that the text matches, in the rules' order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), label) for label, p in rules]))


def size_grade(w: Column, h: Column) -> Column:
    """T27."""
    return F.when((w < 80) | (h < 80), "ignore").when(F.greatest(w, h) / F.least(w, h) > 8, "ignore").when((w >= 200) & (h >= 200), "high").otherwise("low")


def clamp_confidence(c: Column) -> Column:
    """What isn't a number counts as 0.5."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.try_cast("double"), F.lit(0.5))))


def letter_grade(p: Column) -> Column:
    """T34."""
    return F.when(p >= 90, "A").when(p >= 80, "B").when(p >= 70, "C").when(p >= 60, "D").otherwise("F")


def minutes_text(seconds: Column) -> Column:
    """Mm:ss; minutes go beyond 60."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60), seconds % 60)


def fact_lines(c: Column, most: int = 40) -> Column:
    """Pieces between line ends, ` ; ` and bullets, without bullets and numbers, of 4 to 220 characters."""
    pieces = F.transform(F.split(c, "\n| ; |•"), lambda p: F.trim(F.regexp_replace(p, r"^[ \t]*([-*]|[0-9]+[.)])[ \t]*", "")))
    return F.slice(F.filter(F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.lit(220))), lambda p: F.length(p) >= 4), 1, most)


def low_content(c: Column, noise: str = r"^[^A-Za-z]*$") -> Column:
    """Under 50 characters, or over 0.6 of the non-blank lines are noise."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    return (F.length(F.trim(c)) < 50) | (F.size(F.filter(lines, lambda x: x.rlike(noise))) > 0.6 * F.size(lines))


# Phrases of failure messages by class; truncation is told by the labels of a failed salvage, as they are written.
TRUNCATION = ("truncation_unterminated_string", "truncation_missing_closing_bracket", "truncation_repeated_object_prefix")
NETWORK = ("urlopen error", "nodename nor servname provided", "name or service not known", "network is unreachable", "temporary failure in name resolution", "request timed out", "repair_timeout")
QUOTA = ("http 429", "resource_exhausted", "prepayment credits are depleted", "quota exceeded", "rate limit", "too many requests")


def failure_classes(message: Column) -> Column:
    """The classes whose phrases a message holds, of truncation, network and quota, in this order; without regard to case but for truncation. None for null."""
    has = lambda c, phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p))
    found = (("truncation", has(message, TRUNCATION)), ("network", has(F.lower(message), NETWORK)), ("quota", has(F.lower(message), QUOTA)))
    return F.array_compact(F.array(*(F.when(x, F.lit(name)) for name, x in found)))
