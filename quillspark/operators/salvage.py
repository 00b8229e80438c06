"""JSON salvage: what parses natively never leaves the JVM, the rest goes through a ladder of repairs, one text at a time."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states of a text that parses, in the order in which they are tried, and of one that doesn't.
PARSED = ("raw", "cleaned", "balanced", "largest")
FAILURES = ("empty_response", "truncation_unterminated_string", "truncation_missing_closing_bracket", "truncation_repeated_object_prefix", "invalid_json")
CLOSER = {"{": "}", "[": "]"}
QUOTES = str.maketrans("“”‘’", "\"\"''")
MARKS = re.compile(r'[\\"{}\[\]]')


def cleaned(text: str) -> str:
    """Without a byte order mark, code fences and commas before a closing bracket; curly quotes made straight."""
    text = text.strip().lstrip("﻿").strip()
    text = re.sub(r"\A```+(?:json|JSON)?\s*", "", text)
    text = text.rstrip()
    if text.endswith("```"):
        text = text.rstrip("`").rstrip()
    return re.sub(r",(\s*[}\]])", r"\1", text).translate(QUOTES).strip()


def spans(text: str) -> tuple[set[tuple[int, int]], int]:
    """Complete bracket spans (start, end) in one pass that knows strings and escapes, and the first bracket's place (-1: none).

    Whether a place lies in a string depends on where one begins to read, so readings of both kinds are followed from the
    first bracket on: wherever JSON begins, one of them is outside of strings. Readings with nothing open merge. A closing
    bracket that doesn't fit the innermost open one is passed over. The pass is linear unless open brackets alternate with
    escaped quotes, each of which adds a reading.
    """
    start = re.search(r"[{\[]", text)
    if not start:
        return set(), -1
    found: set[tuple[int, int]] = set()
    readings: list[list] = [[[], False, -1]]  # open brackets, in a string, the place that is escaped
    for m in MARKS.finditer(text, start.start()):
        at, ch = m.start(), m[0]
        for r in readings:
            opened, quoted, escaped = r
            if quoted:
                if at == escaped:
                    continue
                if ch == "\\":
                    r[2] = at + 1
                elif ch == '"':
                    r[1] = False
            elif ch == '"':
                r[1] = True
            elif ch in CLOSER:
                opened.append(at)
            elif ch != "\\" and opened and CLOSER[text[opened[-1]]] == ch:
                found.add((opened.pop(), at + 1))
        if len({r[1] for r in readings}) == 1:
            readings.append([[], not readings[0][1], -1])
        if len(readings) > 2:
            open_ones = [r for r in readings if r[0]]
            kinds = {r[1] for r in open_ones}
            readings = open_ones + [next(r for r in readings if r[1] == kind) for kind in (False, True) if kind not in kinds]
    return found, start.start()


def parse(text: str) -> tuple[bool, int]:
    """Whether a text is JSON, and if not, where it fails; nesting beyond Python's recursion fails at the start."""
    try:
        json.loads(text)
        return True, -1
    except json.JSONDecodeError as e:
        return False, e.pos
    except (RecursionError, ValueError):
        return False, 0


def failure(text: str, key: str) -> str:
    """Why no JSON was found in a cleaned text; key: the field whose repeated value shows a repeated object."""
    if not text:
        return FAILURES[0]
    quoted, escaped, depth = False, -1, Counter()
    for m in MARKS.finditer(text):
        at, ch = m.start(), m[0]
        if at == escaped:
            continue
        if quoted and ch == "\\":
            escaped = at + 1
        elif ch == '"':
            quoted = not quoted
        elif not quoted:
            depth[ch] += 1
    if quoted:
        return FAILURES[1]
    if depth["{"] > depth["}"] or depth["["] > depth["]"]:
        return FAILURES[2]
    values = re.findall(rf'"{re.escape(key)}"\s*:\s*("[^"]+"|[0-9]+)', text)
    return FAILURES[3] if len(values) > len(set(values)) else FAILURES[4]


def salvage(text: str | None, key: str = "id") -> tuple[str, str | None]:
    """State and JSON: the text itself, cleaned, the first bracket's balanced span, or the largest complete span that parses."""
    raw = (text or "").strip()
    if raw and parse(raw)[0]:
        return PARSED[0], raw
    clean = cleaned(raw)
    if clean and clean != raw and parse(clean)[0]:
        return PARSED[1], clean
    complete, first = spans(clean)
    balanced = next((s for s in complete if s[0] == first), None)
    if balanced and parse(clean[slice(*balanced)])[0]:
        return PARSED[2], clean[slice(*balanced)]
    # Where a span fails, every span around that place fails too.
    failed: list[int] = []
    for a, b in sorted(complete, key=lambda s: (s[0] - s[1], s)):
        k = bisect_left(failed, a + 1)
        if k < len(failed) and failed[k] < b:
            continue
        ok, at = parse(clean[a:b])
        if ok:
            return PARSED[3], clean[a:b]
        insort(failed, a + at)
    return failure(clean, key), None


def salvage_json(df: DataFrame, id_column: str, column: str, key: str = "id") -> DataFrame:
    """id, state, json of each row's text in `column`: a text that try_parse_json reads stays in the JVM, the others are salvaged.

    state: one of PARSED with the JSON found, or of FAILURES with null. Null and blank texts are empty responses. Repeated
    rows stay; no rows: none.
    """
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("string").alias("text")).withColumn("fine", F.try_parse_json("text").isNotNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [salvage(t, key) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"].astype("Int64"), "state": [s for s, _ in got], "json": [j for _, j in got]})

    native = rows.where("fine").select("id", F.lit(PARSED[0]).alias("state"), F.btrim("text", F.lit(" \t\r\n")).alias("json"))
    return native.unionByName(rows.where("NOT fine OR fine IS NULL").select("id", "text").mapInPandas(run, "id long, state string, json string"))
