"""Words of whole texts as numbers, batch by batch, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.shared import ragged


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Offsets (len(texts) + 1) and all words `[^\\x20\\x09-\\x0D]+`; null has none. lower: A-Z only."""
    # Lower first: of a slice that was cast, ascii_lower reads the wrong bytes.
    texts = pc.fill_null((pc.ascii_lower(texts) if lower else texts).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, ends = lists.flatten(), np.asarray(lists.offsets, np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end leaves empty words
        words = words.filter(pa.array(full))
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
    return ends, words


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, and the distinct words in the order of their numbers."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def owners(ends: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 numbers (a finalizer of two multiplications)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit number for each word, from its bytes alone: a polynomial modulo 2**64, then mixed."""
    distinct = distinct.cast(pa.large_string())
    offsets = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    if not len(distinct):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    powers = np.cumprod(np.full(max(1, int(lengths.max())), 0x9E3779B97F4A7C15 | 1, np.uint64))
    at = ragged(offsets[:-1], lengths)
    weighted = mixed(data[at].astype(np.uint64) + np.uint64(1)) * powers[ragged(np.zeros(len(lengths), np.int64), lengths)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weighted, dtype=np.uint64)])
    ends = np.cumsum(lengths)
    return mixed(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and len(texts) + 1 offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = (texts.buffers()[2] or pa.py_buffer(b"")).slice(offsets[0], offsets[-1] - offsets[0]) if len(texts) else b""
    points = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(lengths)])
