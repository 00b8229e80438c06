"""Wrapped lines: a line takes the next one in while one of six rules says so; a fold along each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tables import bound_batches, slices

# Words that make a line wait for the next one, or that begin a continuation.
ALONE = ("empiric", "treatment", "urine", "blood", "sputum", "stool", "serum", "oral", "iv")
AT_END = ("empiric", "urine", "blood", "sputum", "stool", "serum", "oral", "iv")
AT_START = ("with", "prior", "to", "for", "while", "and", "or", "but", "plus", "culture", "treatment")
WHOLE = ("started, consider",)
LAST_WORDS = ("renal artery",)
#: Texts that are Python objects at once.
TEXTS = 50
#: Words of a line that a continuation may follow, of a line that a short one may follow, and of a short one.
FEW, SOME, SHORT = 2, 5, 2

_SPACE, _WORD = re.compile(r"[ \t\n\r\f\v]+"), re.compile(r"\w+")
_START = re.compile(rf"(?:{'|'.join(AT_START)})\b")
_END = re.compile(rf"\b(?:{'|'.join(AT_END)}|{'|'.join(LAST_WORDS)})\Z")
STRIPPED = " -•\t"
#: More characters than any of the fixed values has.
EDGE = 40


def joins(head: str, tail: str, words: int, after: str) -> bool:
    """Whether `after` continues a line that begins with head, ends in tail (both in lower case; one and the same if it is short) and has so many words."""
    return bool(
        (head == tail and (head.strip(":") in ALONE or head in WHOLE))
        or (words <= FEW and _START.match(after.lower()))
        or _END.search(tail)
        or (words <= SOME and len(_WORD.findall(after)) <= SHORT and not after.endswith(":"))
    )


def join_lines(text: str) -> list[str]:
    """Lines without blanks around, list marks and empty ones, wrapped ones joined by a blank.

    Of a joined line only its first and last EDGE characters and its number of words are looked at, so the fold is linear.
    """
    out: list[list[str]] = []
    head = tail = ""
    words = 0
    for line in (_SPACE.sub(" ", x).strip(STRIPPED) for x in re.split(r"\r\n|\n|\r", text)):
        if not line:
            continue
        low, n = line.lower(), len(_WORD.findall(line))
        if out and joins(head, tail, words, line):
            out[-1].append(line)
            head, tail, words = f"{head} {low[:EDGE]}"[:EDGE], f"{tail} {low[-EDGE:]}"[-EDGE:], words + n
        else:
            out.append([line])
            head, tail, words = low[:EDGE], low[-EDGE:], n
    return [" ".join(x) for x in out]


def unwrap(docs: DataFrame) -> DataFrame:
    """doc_id, k (from 1), line of each text of docs (doc_id, text; others are ignored), in order.

    Null and blank texts have no lines; repeated rows are folded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            yield numbered_lines(((r["doc_id"], join_lines(r["text"])) for r in batch.to_pylist() if r["text"]), "doc_id")

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, k long, line string")


def numbered_lines(found: Iterator[tuple[int, list[str]]], name: str) -> pa.RecordBatch:
    out = [(d, k, x) for d, lines in found for k, x in enumerate(lines, 1)]
    ids, places, texts = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], [name, "k", "line"])


def atomic_lines(slides: DataFrame, relevant: str = ".") -> DataFrame:
    """C14: slide_id, k (from 1), line: distinct relevant lines of slides (slide_id, blocks, notes, tables), in order.

    blocks is an array of texts and notes a text, both unwrapped; tables an array of (headers, rows), of which a row becomes its
    cells joined by ` | ` after the first header. Lines have 4 to 260 characters and match `relevant`; one that was there
    before, but for case and blanks, goes. Nulls are empty; repeated rows are cut each.
    """

    def cut(blocks: list[str] | None, notes: str | None, tables: list[dict] | None) -> list[str]:
        lines = [x for text in [*(blocks or ()), notes] if text for x in join_lines(text)]
        for table in tables or ():
            headers = [str(h or "").strip() for h in (table["headers"] if table and table["headers"] else ())]
            for row in table["rows"] if table and table["rows"] else ():
                cells = [c for x in (row or ()) if (c := str(x or "").strip())]
                if cells:
                    lines.append((f"{headers[0]}: " if headers and headers[0] else "") + " | ".join(cells))
        clean = (_SPACE.sub(" ", x).strip(STRIPPED) for x in lines)
        kept = {x.lower(): x for x in reversed([x for x in clean if 4 <= len(x) <= 260 and wanted.search(x)])}
        return list(reversed(kept.values()))

    wanted = re.compile(relevant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few slides are Python objects at once, whatever an Arrow batch holds.
        for batch in slices(batches, TEXTS):
            yield numbered_lines(((r["slide_id"], cut(r["blocks"], r["notes"], r["tables"])) for r in batch.to_pylist()), "slide_id")

    rows = slides.select(F.col("slide_id").cast("long").alias("slide_id"), "blocks", "notes", "tables")
    bound_batches(slides.sparkSession)
    return rows.mapInArrow(run, "slide_id long, k long, line string")
