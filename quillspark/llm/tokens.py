"""Token ids of whole texts, encoding each distinct piece of text once."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.shared import give_back, ragged

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes after or before which a multi-byte white space may stand.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_UNSURE[0x1C:0x20] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[33, 34, 35, 36, 37, 38, 40, 41, 42, 44, 46, 58, 59, 63, 124]] = True

#: Pieces without white space but for one at the start, and without what may be a multi-byte one.
_PLAIN = re.compile(rb"[\t ]?[!-~\x80-\xc0\xc3-\xe0\xe4-\xff]+").fullmatch


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def shared_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that a piece which many tasks meet is encoded once a worker."""
    return Encoder(path)


def drop_encoders() -> None:
    """For tasks that encode nothing: a worker of an earlier packing still holds an encoder, with all its pieces."""
    shared_encoder.cache_clear()
    give_back()


class Encoder:
    """Encodes texts with a byte-level tokenizers file, as the library does with add_special_tokens=False.

    Texts that hold an added token, such as an end mark, go to the library whole. Of the others:
    Its pre-tokenizer never joins what stands before and after (a) a lone ASCII white space
    between two other characters, or (b) a letter followed by a punctuation mark other than an
    apostrophe. Texts are cut there, and each distinct piece is encoded once.
    """

    def __init__(self, path: str, cached: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached = cached
        #: The pool holds the ids of the known pieces; piece k has lengths[k] ids from begins[k] and was met in met[k] calls. Arrays are
        #: longer than what they hold.
        self.known: dict[bytes, int] = {}
        self.used = 0
        self.pool, self.begins, self.lengths, self.met = np.zeros(1 << 16, np.uint32), *(np.zeros(1 << 16, np.int64) for _ in range(3))

    def _forget(self) -> None:
        """Forgets the pieces met once since they were last weighed, most of what a corpus has; of the others half a cache stays at most, the most met."""
        met = self.met[: len(self.known)]
        keep = np.flatnonzero(met > 1)
        if len(keep) > self.cached // 2:
            keep = np.sort(keep[np.argpartition(-met[keep], self.cached // 2)[: self.cached // 2]])
        names = list(self.known)  # in the order of their numbers
        self.known = {names[k]: n for n, k in enumerate(keep.tolist())}
        begins, lengths = self.begins[keep], self.lengths[keep]
        ids = self.pool[ragged(begins, lengths)]
        self.used, size = len(ids), len(keep)
        self.pool[: self.used] = ids
        self.begins[:size], self.lengths[:size], self.met[:size] = np.cumsum(lengths) - lengths, lengths, (met[keep] + 1) // 2

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, one after the other, and len(texts) + 1 offsets. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.zeros(len(texts), bool)
        for token in self.added:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._plain(texts)
        ids, ends = self._plain(pc.if_else(pa.array(marked), pa.scalar("", pa.large_string()), texts))
        whole = {k: np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32) for k in np.flatnonzero(marked).tolist()}
        parts = [whole[k] if k in whole else ids[ends[k] : ends[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cuts = np.zeros(len(data) + 1, bool)
        cuts[offsets] = True
        cuts[1:-1] |= _safe_cuts(data)
        starts = np.flatnonzero(cuts)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        which = self._numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        lengths = self.lengths[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[ragged(self.begins[which], lengths)], ends[np.searchsorted(starts, offsets)]

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        look = lambda: np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        got = look()
        self.met[got[got >= 0]] += 1  # pieces are distinct
        if self.known and len(self.known) + (got < 0).sum() > self.cached:
            self._forget()
            got = look()
        missing = np.flatnonzero(got < 0)
        if len(missing):
            new = [pieces[k] for k in missing]
            first, last = len(self.known), len(self.known) + len(new)
            got[missing] = np.arange(first, last)
            ids, lengths = self._encoded(new)
            self.known.update(zip(new, got[missing].tolist(), strict=True))
            self.begins, self.lengths, self.met, self.pool = _room(self.begins, last), _room(self.lengths, last), _room(self.met, last), _room(self.pool, self.used + len(ids))
            self.met[first:last] = 1
            self.begins[first:last] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first:last] = lengths
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return got

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Plain pieces are encoded many at a time with line ends between, which cost one id each."""
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        lengths = np.zeros(len(pieces), np.int64)
        plain = np.fromiter((_PLAIN(x) is not None for x in pieces), bool, len(pieces)) & (len(line_end) == 1)
        parts, order = [], []
        for rows in np.split(np.flatnonzero(plain), range(5000, len(pieces), 5000)):
            if len(rows):
                # The batch call, though for one text, leaves out places in the text, which nothing here asks for.
                joined = self.tokenizer.encode_batch_fast([b"\n".join([pieces[k] for k in rows]).decode()], add_special_tokens=False)[0].ids
                joined = np.array([*joined, *line_end], np.uint32)
                ends = np.flatnonzero(joined == line_end[0])
                lengths[rows] = np.diff(ends, prepend=-1) - 1
                parts.append(joined[joined != line_end[0]])
                order.append(rows)
        rows = np.flatnonzero(~plain)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in rows], add_special_tokens=False)]
        lengths[rows] = np.fromiter(map(len, rest), np.int64, len(rest))
        parts += [np.array(x, np.uint32) for x in rest]
        order = np.concatenate([*order, rows])
        begins = np.empty(len(pieces), np.int64)
        begins[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(parts)[ragged(begins, lengths)], lengths


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one of at least twice its length that begins with it."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


def _safe_cuts(data: np.ndarray) -> np.ndarray:
    """For each byte but the first: whether the text can be cut before it."""
    space, unsure = _SPACE[data], _UNSURE[data]
    lead = np.concatenate([[0], data[:-2]]) if len(data) > 1 else np.zeros(0, np.uint8)
    before, here = data[:-1], data[1:]
    latin = (lead == 0xC3) & (before != 0x97) & (before != 0xB7) & (before >= 0x80)
    #: An ASCII character, or a letter of two bytes that is no white space.
    plain = ((before < 0x80) & ~_UNSURE[before]) | (lead == 0xC3) | (lead == 0xC4) | (lead == 0xC5)
    after = np.concatenate([~(space | unsure)[2:], [True]]) if len(data) > 1 else np.zeros(0, bool)
    lone = space[1:] & ~space[:-1] & plain & after
    return lone | (_MARK[here] & (_LETTER[before] | latin))
