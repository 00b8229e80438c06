"""Fill-in-the-middle transformation: bytes of whole batches are moved by displacement scatter, and back by gather.

A text in UTF-8 is cut at two code points. The bytes of one segment all move by the same distance, so a batch's
displacements are the running sum of a difference array that is not zero at the cuts only. Outputs are one scatter by
place plus displacement, restored texts one gather from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
MARK = 3
#: Bytes that are moved at once: what a long text needs beside itself is bounded by it.
BLOCK = 1 << 22


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; null is empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def cut_places(data: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The byte at which each cut lies. cuts: one or more rows of code points for each text, not above its length."""
    first = np.concatenate([[0], np.cumsum([np.count_nonzero((data[a : a + BLOCK] & 0xC0) != 0x80) for a in range(0, len(data), BLOCK)])])
    before = starts_before(data, ends[:-1], first)
    wanted = before[None, :] + cuts  # code points of the batch before the cut
    out = np.full(wanted.shape, len(data), np.int64)
    for k, a in enumerate(range(0, len(data), BLOCK)):
        here = (wanted >= first[k]) & (wanted < first[k + 1])
        if here.any():
            starts = np.flatnonzero((data[a : a + BLOCK] & 0xC0) != 0x80)
            out[here] = a + starts[wanted[here] - first[k]]
    return out


def starts_before(data: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code points that start before each place; first: those before each block."""
    out = first[np.minimum(places // BLOCK, len(first) - 1)].astype(np.int64)
    for k in np.unique(places // BLOCK):
        here = places // BLOCK == k
        block = np.concatenate([[0], np.cumsum((data[k * BLOCK : (k + 1) * BLOCK] & 0xC0) != 0x80)])
        out[here] += block[places[here] - k * BLOCK]
    return out


def displacements(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the displacement of each byte: (first byte, displacements). starts ascend; segment k moves by shifts[k].

    Empty segments begin where the next one does; their differences add up in one place.
    """
    steps, carried, at = np.diff(shifts, prepend=0), 0, 0
    for a in range(0, size, BLOCK):
        b = min(size, a + BLOCK)
        until = at + int(np.searchsorted(starts[at:], b))
        change = np.zeros(b - a, np.int64)
        np.add.at(change, starts[at:until] - a, steps[at:until])
        change[0] += carried
        block = np.cumsum(change)
        carried, at = int(block[-1]), until
        yield a, block


def segments_of(ends: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and displacements of the segments prefix, middle, suffix of each text, ends of the outputs, and places of the marks.

    cuts: two rows of bytes; forms: numbers in FORMS. Marks stand in the order prefix, suffix, middle, one row each.
    """
    begin, end = ends[:-1], ends[1:]
    marked = forms != 0
    a, b = np.where(marked, cuts[0], end), np.where(marked, cuts[1], end)
    out_ends = np.concatenate([[0], np.cumsum(end - begin + 3 * MARK * marked)])
    out, suffix = out_ends[:-1], end - b
    swapped = forms == 2
    p_mark = np.where(swapped, out + MARK + suffix, out)
    s_mark = np.where(swapped, out, out + MARK + (a - begin))
    m_mark = out + 2 * MARK + (a - begin) + suffix
    places = (np.where(marked, p_mark + MARK, out), m_mark + MARK, s_mark + MARK)  # of prefix, middle, suffix
    starts = np.stack([begin, a, b], 1).ravel()
    shifts = np.stack([p - s for p, s in zip(places, (begin, a, b), strict=True)], 1).ravel()
    return starts, shifts, out_ends, np.stack([p_mark, s_mark, m_mark])[:, marked]


def scatter(data: np.ndarray, ends: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of a batch: bytes and ends."""
    starts, shifts, out_ends, marks = segments_of(ends, cuts, forms)
    out = np.empty(out_ends[-1], np.uint8)
    for a, move in displacements(starts, shifts, len(data)):
        out[np.arange(a, a + len(move)) + move] = data[a : a + len(move)]
    for at, mark in zip(marks, (PREFIX, SUFFIX, MIDDLE), strict=True):
        for k, byte in enumerate(mark):
            out[at + k] = byte
    return out, out_ends


def mark_places(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Where a mark begins, anywhere in a batch."""
    at = np.flatnonzero(data[: max(0, len(data) - MARK + 1)] == mark[0])
    for k in range(1, MARK):
        at = at[data[at + k] == mark[k]]
    return at


def gather(data: np.ndarray, ends: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts restored from outputs and forms alone: the marks found in an output give back its cuts and displacements."""
    begin, end, marked = ends[:-1], ends[1:], forms != 0
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = mark_places(data, mark)
        owner = np.searchsorted(ends, at, side="right") - 1
        keep = marked[owner]
        found = np.full(len(begin), -1, np.int64)
        found[owner[keep]] = at[keep]
        if (np.bincount(owner[keep], minlength=len(begin))[marked] != 1).any():
            raise ValueError("an output has not one of each mark")
        place[mark] = found
    p, s, m = (place[x] for x in (PREFIX, SUFFIX, MIDDLE))
    prefix = np.where(forms == 2, m, s) - p - MARK
    middle = end - m - MARK
    sizes = end - begin - 3 * MARK * marked
    text_ends = np.concatenate([[0], np.cumsum(sizes)])
    a = text_ends[:-1] + prefix
    starts, shifts, out_ends, _ = segments_of(text_ends, np.stack([a, a + middle]), forms)
    if not np.array_equal(out_ends, ends):
        raise ValueError("outputs do not fit their forms")
    text = np.empty(text_ends[-1], np.uint8)
    for k, move in displacements(starts, shifts, len(text)):
        text[k : k + len(move)] = data[np.arange(k, k + len(move)) + move]
    return text, text_ends


def part_of_hash(doc_id: Column, k: int) -> Column:
    """The k-th (from 1) group of eight hex digits of sha256("1:" and the decimal doc_id), as a number; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def plan(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, text (null: empty), n, form and the cuts in code points (null where plain), by hashes of doc_id."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("n", F.char_length("text").cast("long"))
    x, y = (part_of_hash(F.col("doc_id"), k) % (F.col("n") + 1) for k in (1, 2))
    has_mark = F.contains("text", F.lit("<P>")) | F.contains("text", F.lit("<S>")) | F.contains("text", F.lit("<M>"))
    plain = (F.col("n") == 0) | has_mark | (part_of_hash(F.col("doc_id"), 3) % 100 >= plain_from)
    form = F.when(plain, FORMS[0]).when(part_of_hash(F.col("doc_id"), 4) % 100 < spm_below, FORMS[2]).otherwise(FORMS[1])
    cut = base.withColumn("form", form)
    marked = F.col("form") != FORMS[0]
    return cut.withColumn("prefix_chars", F.when(marked, F.least(x, y))).withColumn("middle_chars", F.when(marked, F.greatest(x, y) - F.least(x, y)))


def _moved(df: DataFrame, column: str, result: str, move: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """df with `column` replaced by what `move` makes of slices of its rows."""
    bound_batches(df.sparkSession)
    names = [c for c in df.columns if c != column]
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in names), f"{result} string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column, 8_000_000):
            moved = move(batch)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), moved.cast(pa.string())], names=[*names, result])

    return df.mapInArrow(run, schema)


def _numbers(forms: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.index_in(forms, pa.array(FORMS, forms.type)).to_numpy(zero_copy_only=False), np.int64)


def transform(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of each row of docs (doc_id, text; others are ignored).

    A null text is empty; an empty text and one that holds a mark stay plain. A null doc_id is cut as if its decimal form
    were empty. Repeated rows stay, and equal ids with equal texts have equal outputs. No documents: no rows. A text of any
    length is moved in blocks.
    """

    def move(batch: pa.RecordBatch) -> pa.Array:
        data, ends = text_bytes(batch["text"])
        prefix, middle = (pa.compute.fill_null(batch[c], 0).to_numpy() for c in ("prefix_chars", "middle_chars"))
        cuts = cut_places(data, ends, np.stack([prefix, prefix + middle]))
        return strings(*scatter(data, ends, cuts, _numbers(batch["form"])))

    return _moved(plan(docs, plain_from, spm_below), "text", "output", move)


def restore(outputs: DataFrame) -> DataFrame:
    """outputs (form, output, ...) with `text` in place of output: exact, from form and output alone."""

    def move(batch: pa.RecordBatch) -> pa.Array:
        return strings(*gather(*text_bytes(batch["output"]), _numbers(batch["form"])))

    return _moved(outputs, "output", "text", move)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' outputs and of the texts restored from them; see `transform` for nulls, ties and empty tables."""
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("output_sha256", F.sha2("output", 256))
    return restore(made).withColumn("restored_sha256", F.sha2("text", 256)).drop("text")


_PART = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8) AS BIGINT)"
OP12_SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, {_PART.format(1)} % (length(coalesce(text, '')) + 1) AS x,
    {_PART.format(9)} % (length(coalesce(text, '')) + 1) AS y, {_PART.format(17)} % 100 AS h3, {_PART.format(25)} % 100 AS h4 FROM documents
), formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form, least(x, y) AS a, greatest(x, y) AS b FROM cut
), made AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM made
"""
