"""Chunking jobs whose order lies inside one document: sequential folds in Arrow batches, one document at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tables import fold_groups, slices

HEADING = re.compile(r"^(#+\s+\S.*|[A-Z][A-Z ]{6,})$", re.M)


def cut_long(text: str, cap: int) -> list[str]:
    """Pieces of at most cap characters: at the last line end, else the last space, in the second half; else by force."""
    out = []
    while len(text) > cap:
        at = max(text.rfind("\n", cap // 2, cap), -1)
        if at < 0:
            at = text.rfind(" ", cap // 2, cap)
        at = at + 1 if at >= 0 else cap
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def sections(text: str, keep_preamble: bool) -> list[str]:
    """Split before headings if there are two or more, else at blank lines. The text before the first heading is dropped unless kept."""
    starts = [m.start() for m in HEADING.finditer(text)]
    if len(starts) < 2:
        return [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    bounds = ([0] if keep_preamble and starts[0] else []) + starts
    return [text[a:b] for a, b in zip(bounds, [*bounds[1:], len(text)], strict=True)]


def chunk_text(text: str, cap: int, keep_preamble: bool = False) -> list[str]:
    """Sections packed greedily, in order, into chunks of at most cap characters."""
    chunks: list[str] = []
    for section in sections(text, keep_preamble):
        for piece in cut_long(section, cap):
            if chunks and len(chunks[-1]) + len(piece) + 1 <= cap:
                chunks[-1] += "\n" + piece
            else:
                chunks.append(piece)
    return chunks


def chunk_documents(docs: DataFrame, cap: int = 3000, keep_preamble: bool = False) -> DataFrame:
    """doc_id, chunk (from 1), text. Null and blank texts have no chunks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, k, c) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for k, c in enumerate(chunk_text(t or "", cap, keep_preamble), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk long, text string")


SEGMENTS = "doc_id long, segment long, first long, last long, words long"


def cut_lines(lines: list[tuple[int, str]], max_words: int) -> list[list[int]]:
    """segment, first, last, words of lines (k, l) in order: a segment closes before the line that would pass max_words."""
    out: list[list[int]] = []
    for k, line in lines:
        n = len(line.split())
        if not out or out[-1][3] + n > max_words:
            out.append([len(out) + 1, k, k, 0])
        out[-1][2] = k
        out[-1][3] += n
    return out


def segments(lines: DataFrame, max_words: int) -> DataFrame:
    """doc_id, segment, first, last, words of lines (doc_id, k, l), one document at a time (see cut_lines)."""
    names = ("segment", "first", "last", "words")

    def fold(group: list[dict]) -> list[dict]:
        return [{"doc_id": group[0]["doc_id"], **dict(zip(names, x, strict=True))} for x in cut_lines([(r["k"], r["l"]) for r in group], max_words)]

    return fold_groups(lines.select("doc_id", "k", "l"), ["doc_id"], ["k"], fold, SEGMENTS)


def text_segments(docs: DataFrame, max_words: int) -> DataFrame:
    """`segments` of the lines of docs (doc_id, unique; text). A text is in one row, so nothing is shuffled. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            rows = [(d, *x) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) if t is not None for x in cut_lines(list(enumerate(t.split("\n"), 1)), max_words)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "segment", "first", "last", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SEGMENTS)


QUESTION = re.compile(r"^(?:Question|Item|\*)?\s*(\d+)[.:)]\s*", re.M)
OPTION = re.compile(r"^([A-I])[).]\s+(.*)$")


def parse_questions(text: str) -> list[tuple[int, str, list[str]]]:
    """Number, stem and options of each question; lines after an option continue it. Text before the first number is skipped."""
    marks = list(QUESTION.finditer(text))
    out = []
    for m, end in zip(marks, [x.start() for x in marks[1:]] + [len(text)], strict=True):
        stem, options = [], []
        for line in text[m.end() : end].splitlines():
            found = OPTION.match(line.strip())
            if found:
                options.append(found[2])
            elif options:
                options[-1] += " " + line.strip()
            elif line.strip():
                stem.append(line.strip())
        if len(options) >= 2:
            out.append((int(m[1]), " ".join(stem), [o.strip() for o in options]))
    return out


def question_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, number, stem, options."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, *q) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for q in parse_questions(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "number", "stem", "options"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, number long, stem string, options array<string>")
