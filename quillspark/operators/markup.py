"""Audit of markup: a stack of open tags for each page, with mismatches and tags left open as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tags that are never opened.
VOID = ("br", "hr", "img", "meta", "input")
#: Their content is text up to their own closing tag.
RAW = ("script", "style")
# Comment, declaration or instruction, closing tag, opening tag with attributes; a `<` before anything else is text.
TAG = re.compile(r"<!--(?:.*?-->|>|->)|<[!?][^>]*>|</([a-zA-Z][^\t\n\r\f />\x00]*)[^>]*>|<([a-zA-Z][^\t\n\r\f />\x00]*)((?:[^>\"']|(?<==)\s*\"[^\"]*\"|(?<==)\s*'[^']*'|[\"'])*?)(/?)>", re.S)
UNEXPECTED, UNCLOSED = "unexpected closing tag", "unclosed tag"


def audit(html: str) -> list[tuple[int, str, str, str | None]]:
    """(place among the tags, from 1; finding; tag; the innermost open tag) in order; tags left open have the place where they were opened."""
    opened: list[tuple[str, int]] = []
    found: list[tuple[int, str, str, str | None]] = []
    at = place = 0
    while m := TAG.search(html, at):
        at = m.end()
        closing, opening = (m[1] or "").lower(), (m[2] or "").lower()
        if not closing and not opening:
            continue
        place += 1
        name = closing or opening
        if opening and opening not in VOID:
            opened.append((opening, place))
            if opening in RAW and not m[4]:
                end = re.compile(rf"</{opening}(?=[\t\n\r\f />])", re.I).search(html, at)
                at = end.start() if end else len(html)
        if (closing or m[4]) and name not in VOID:
            if opened and opened[-1][0] == name:
                opened.pop()
            else:
                found.append((place, UNEXPECTED, name, opened[-1][0] if opened else None))
    found += [(k, UNCLOSED, name, opened[i - 1][0] if i else None) for i, (name, k) in enumerate(opened)]
    return found


def markup_findings(pages: DataFrame) -> DataFrame:
    """page_id, place, finding, tag, inside: a row for each closing tag that doesn't fit the innermost open one and each tag left open.

    pages: page_id, html; others are ignored. A page is read by itself; null and empty pages have no findings, repeated rows
    are audited each, void tags are never open, and a tag that closes itself is opened and closed.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *x) for p, h in zip(frame["page_id"], frame["html"], strict=True) if h for x in audit(h)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "finding", "tag", "inside"]).astype({"page_id": "Int64", "place": "Int64"})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInPandas(run, "page_id long, place long, finding string, tag string, inside string")


def markup_summary(findings: DataFrame) -> DataFrame:
    """finding, tag, pages, rows: by kind of finding and tag."""
    return findings.groupBy("finding", "tag").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("rows"))
