"""Language-model scoring with a probabilistic suffix tree over words, beside a unigram base.

A node of the tree is a context: the last words before a token, up to `depth` of them, and the start of the document. The tree
is never held in one place. Documents are cut into slices of bounded size; a slice sends the hashed events and contexts that stand in
it, in sorted arrays, to the range of hashes that counts them, and gets back the totals over the whole corpus for exactly these. So what
is gathered grows with the corpus, a hot event takes one place a slice, and nothing is broadcast.

The same exchange serves all that a context needs. Each event belongs to one of the slices that hold it in training; this one adds, for
the event's context, 1 to the distinct next tokens and the event's term to the divergence from the suffix. Whether a context is
retained is decided where its terms meet, so that one bit goes back and not the divergence.

Slices, and the ranges of an exchange, are taken in PASSES passes, each of which frees its shuffle before the next begins: so what is
written and its copy in a shuffle don't lie on disk together as wholes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, discard, free_shuffles, text_slices, written
from quillspark.llm.words import mixed, numbered, owners, word_hashes, words_of

#: Bytes of text in a slice, and tokens for which there is a range of hashes.
SLICE, TOKENS_A_RANGE = 6_000_000, 2_000_000
#: Parts of slices and of ranges that are shuffled one after the other.
PASSES = 4
#: Divergences travel as whole numbers of 1e-4 nats, which add up alike in any order.
UNIT = 1e4
SENT = "range long, slice long, keys binary, a binary, b binary"
TOTALS = "slice long, trip int, range long, a binary, b binary, owned binary, words long"
PACKED = "slice long, n_tokens long, n_trained long, doc_ids array<bigint>, ends binary, hashes binary, which binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: pa.Array, modulus: int = 7, remainder: int = 2) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if k is None else str(k).encode()) % modulus == remainder for k in doc_id.to_pylist()), bool, len(doc_id))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def packed(x: np.ndarray) -> bytes:
    """x with the equal bytes of its numbers side by side, compressed."""
    rows = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    planes = np.empty(rows.shape[::-1], np.uint8)
    for k in range(len(planes)):  # byte by byte: numpy copies a transposed array many times slower
        planes[k] = rows[:, k]
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    rows = np.empty(planes.shape[::-1], np.uint8)
    for k in range(len(planes)):
        rows[:, k] = planes[k]
    return rows.reshape(-1).view(kind)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct uint64 keys, ascending, and which of them each key is.

    Numbers that hold a key's highest bits and its place are sorted, as numpy sorts numbers several times faster than it finds
    their order. Different keys that agree in these bits are rare; np.unique takes over where they come out of order.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    least = keys.min()
    both = (keys - least) << np.uint64(64 - max(1, int(keys.max() - least).bit_length()))
    both &= ~low
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= low
    order = both.view(np.int64)
    ascending = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=fresh[1:])
    found = ascending[fresh]
    if (found[1:] <= found[:-1]).any():
        return np.unique(keys, return_inverse=True)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return found, back


def slices(docs: DataFrame) -> DataFrame:
    """Tokens of the documents as PACKED rows: distinct word hashes, and which of them each token is; the end's is 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(text_slices(batches, "text", SLICE)):
            ends, words = words_of(batch["text"], lower=True)
            which, spelt = numbered(words)
            # An end after each text. Hashes ascend, so that their differences can be sent.
            which = np.insert(which, ends[1:], len(spelt))
            ends = ends + np.arange(len(ends))
            hashes, rank = distinct(np.append(word_hashes(spelt), np.uint64(0)))
            which = rank.astype(np.int32)[which]
            trained = int(np.diff(ends)[~held_out(batch["doc_id"])].sum())
            row = {"slice": [first + k], "n_tokens": [len(which)], "n_trained": [trained], "doc_ids": pa.array([batch["doc_id"].to_pylist()], pa.list_(pa.int64())), "ends": [packed(ends)], "hashes": [packed(np.diff(hashes, prepend=np.uint64(0)))], "which": [packed(which)]}
            yield pa.RecordBatch.from_pydict(row)

    return texts_of(docs).mapInArrow(cut, PACKED)


class Slice:
    """The tokens of a slice, and what is known of their events and contexts after each exchange."""

    def __init__(self, row: dict, depth: int):
        self.doc_ids = pa.array(row["doc_ids"], pa.int64())
        ends, hashes, self.which = unpacked(row["ends"], np.int64), np.cumsum(unpacked(row["hashes"], np.uint64), dtype=np.uint64), unpacked(row["which"], np.int32)
        self.doc, self.depth = owners(ends), depth
        self.held = held_out(self.doc_ids)
        self.train = ~self.held[self.doc]
        self.place = np.arange(len(self.which)) - ends[:-1][self.doc]
        self.starts, self.finals = ends[:-1], ends[1:] - 1
        #: Keys of tokens are even, all others odd, so that ranges can count the tokens.
        self.word_keys = mixed(hashes + np.uint64(0x632BE59BD9B4E019)) & ~np.uint64(1)
        self.event = [self.word_keys[self.which]]
        for _ in range(depth):
            self.event.append(mixed(self.before(self.event[-1]) * np.uint64(0x9E3779B97F4A7C15) + self.event[0]) | np.uint64(1))
        self.n: list[np.ndarray] = []
        #: For each length, one token of each event that belongs to this slice.
        self.owned: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        #: For each length, the tokens whose context of that length is retained.
        self.kept = [np.ones(len(self.which), bool)]

    def before(self, values: np.ndarray) -> np.ndarray:
        """The values of the token before each; at the start of a text that of the end, as no text goes on after its end."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = values[self.finals]
        return out

    def reachable(self, d: int) -> np.ndarray:
        """Tokens with a context of d places, the start of the text among them, that occurs twice in training."""
        return (self.place >= d - 1) & (self.before(self.n[d - 1]) >= 2)

    def keys(self, trip: int) -> np.ndarray:
        """Keys (with repeats) of exchange `trip`, as `asked` gives them."""
        if trip == 0:
            return np.concatenate([self.word_keys, self.event[1]]) if self.depth else self.word_keys
        keys = self.before(self.event[trip - 1])[self.reachable(trip) & self.kept[trip - 1]]
        if trip < self.depth:
            keys = np.concatenate([keys, mixed(self.event[trip + 1][self.open(trip + 1)]) | np.uint64(1)])
        return keys

    def asked(self, trip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (with repeats), and their two addends, of exchange `trip`.

        0: counts of tokens and of their events after one. trip >= 1: divergence and distinct next tokens of the contexts of
        `trip` places whose suffixes are retained, and counts of events after one place more, where these can matter.
        """
        if trip == 0:
            times = np.bincount(self.which, self.train, len(self.word_keys)).astype(np.int64)
            a = np.concatenate([times, self.train]) if self.depth else times
            return self.keys(trip), a.astype(float), np.zeros(len(a))
        use = self.reachable(trip) & self.kept[trip - 1]
        t = use & self.owned[trip]
        n, of = self.n[trip], self.before(self.n[trip - 1])
        # The suffix of a context of one place is the root, which has seen all tokens.
        suffix = self.total if trip == 1 else self.before(self.n[trip - 2])
        gain, one = np.zeros(len(n)), np.zeros(len(n))
        gain[t] = n[t] * np.log(n[t] / of[t] * (suffix if trip == 1 else suffix[t]) / self.n[trip - 1][t]) * UNIT
        one[t] = 1
        a, b = gain[use], one[use]
        if trip < self.depth:
            more = self.open(trip + 1)
            a, b = np.concatenate([a, self.train[more]]), np.concatenate([b, np.zeros(more.sum())])
        return self.keys(trip), a, b

    def open(self, d: int) -> np.ndarray:
        """Tokens whose event after d places has to be asked for: one that never occurs after d - 1 places doesn't after d."""
        return self.reachable(d) & (self.n[d - 1] >= 1)

    def learn(self, trip: int, a: np.ndarray, b: np.ndarray, owned: np.ndarray, total: int) -> None:
        """Takes the totals of exchange `trip`, in the order of its distinct keys."""
        self.total = total
        keys, back = distinct(self.keys(trip))
        first = np.empty(len(keys), np.int64)
        first[back] = np.arange(len(back))
        mine = np.zeros(len(back), bool)
        mine[first[owned]] = True
        a, b = a[back], b[back]
        if trip == 0:
            words = len(self.word_keys)
            self.n.append(a[:words][self.which])
            self.owned.append(np.zeros(0, bool))
            if self.depth:
                self.n.append(a[words:])
                self.owned.append(mine[words:])
            return
        use = self.reachable(trip) & self.kept[trip - 1]
        size = int(use.sum())
        one, kept = np.zeros(len(use)), np.zeros(len(use), bool)
        one[use], kept[use] = b[:size], (a[:size] > 0) | (b[:size] == 0)
        self.sums.append(one)
        self.kept.append(kept)
        if trip < self.depth:
            n, more, of = np.zeros(len(use), np.int64), self.open(trip + 1), np.zeros(len(use), bool)
            n[more], of[more] = a[size:], mine[size:]
            self.n.append(n)
            self.owned.append(of)

    def scores(self, words: int, discount: float) -> dict[str, object]:
        base = (self.n[0] + 1) / (self.total + words + 1)
        p = base.copy()
        for d in range(1, self.depth + 1):
            one, kept = self.sums[d - 1], self.kept[d]
            of = self.before(self.n[d - 1])[kept]
            p[kept] = np.maximum(self.n[d][kept] - discount, 0) / of + discount * one[kept] / of * p[kept]
        rows = len(self.doc_ids)
        each = lambda x: np.bincount(self.doc, x, rows)
        return {"doc_id": self.doc_ids, "held_out": self.held, "n_tokens": np.bincount(self.doc, minlength=rows), "n_known": each(self.n[0] > 0).astype(np.int64), "base_score": each(np.log10(base)), "score": each(np.log10(p))}


def ask(part: Slice, number: int, trip: int, ranges: int) -> pa.Table:
    """The distinct keys of an exchange and the sums of their addends, a row for each range of keys (SENT)."""
    keys, a, b = part.asked(trip)
    found, back = distinct(keys)
    a, b = (np.rint(np.bincount(back, x, len(found))).astype(np.int64) for x in (a, b))
    bounds = [(r << 64) // ranges for r in range(ranges)]
    cuts = np.append(np.searchsorted(found, np.array(bounds, np.uint64)), len(found))
    full = np.flatnonzero(np.diff(cuts))
    step = lambda k: packed(np.diff(found[cuts[k] : cuts[k + 1]], prepend=np.uint64(0)))
    piece = lambda x, k: packed(x[cuts[k] : cuts[k + 1]])
    return pa.table({"range": full, "slice": np.full(len(full), number), "keys": pa.array([step(k) for k in full], pa.binary()), "a": pa.array([piece(a, k) for k in full], pa.binary()), "b": pa.array([piece(b, k) for k in full], pa.binary())})


def summed(trip: int, cost: float) -> Callable[[pa.Table], pa.Table]:
    """For a range of keys: the totals over all slices, given back to each slice; words: how many tokens of the range occur in training.

    Of a context, which alone has distinct next tokens (b), a is 1 if it is retained, else 0.
    """

    def total(sent: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in sent["keys"].to_pylist()]
        found, back = distinct(np.concatenate(keys))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        a, b = (np.concatenate([unpacked(x, np.int64) for x in sent[c].to_pylist()]) for c in ("a", "b"))
        sums = [np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)]
        np.add.at(sums[0], back, a)
        np.add.at(sums[1], back, b)
        context = sums[1] > 0
        sums[0][context] = sums[0][context] / UNIT >= cost * sums[1][context]
        # The first slice that holds an event in training owns it.
        holds = np.flatnonzero(a > 0)[::-1]
        first = np.full(len(found), -1)
        first[back[holds]] = holds
        owned = np.zeros(len(back), np.uint8)
        owned[first[first >= 0]] = 1
        words = np.zeros(len(keys), np.int64)
        if trip == 0:
            words[0] = ((found & np.uint64(1) == 0) & (sums[0] > 0)).sum()
        split = lambda x: pa.array([packed(part) for part in np.split(x, cuts)], pa.binary())
        return pa.table({"slice": sent["slice"], "trip": pa.array([trip] * len(keys), pa.int32()), "range": sent["range"], "a": split(sums[0][back]), "b": split(sums[1][back]), "owned": split(owned), "words": words})

    return total


def scores(docs: DataFrame, depth: int = 2, cost: float = 1.0, discount: float = 0.75) -> DataFrame:
    """Per row of docs (doc_id, text; others are ignored): held_out, n_tokens, n_known, train_tokens, base_score, score, score_per_token.

    Tokens are words, lower-cased in A-Z, and one end. Learnt from documents that aren't held out. base_score: the
    unigram with one added. score: log10 of the text's probability under the tree. A context of 1 to `depth` places, the start of the text
    being one, is retained if its suffix is, if it occurs twice or more, and if its empirical distribution diverges from its suffix's by `cost` nats
    or more (count times Kullback-Leibler divergence) for each distinct next token that it would store. A token is scored in the
    longest retained suffix of what is before it: distributions are smoothed by absolute discounting towards that of the suffix, the root by the base.
    Null and empty texts have the end alone. Rows with equal doc_ids are scored each. No documents: no rows; no training
    documents: uniform distributions. A text is never cut, so one far longer than SLICE makes a slice of its own.
    """
    bound_batches(docs.sparkSession, 2000)
    parts = written(slices(docs), "slices")
    sizes = parts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_trained"), F.lit(0)).alias("trained")).first()
    ranges, trained = max(1, -(-sizes.n // TOKENS_A_RANGE)), int(sizes.trained)
    empty = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    own = parts.select("slice", F.lit(-1).alias("trip"), F.lit(0).cast("long").alias("range"), *empty("a", "b", "owned"), "doc_ids", "ends", "hashes", "which")

    def known(rows: pa.Table, made: int) -> tuple[int, Slice]:
        """A slice with the totals of the `made` exchanges so far; it may have asked nothing in one."""
        order = rows.select(["trip", "range"]).to_pandas().sort_values(["trip", "range"], kind="stable").index.to_numpy()
        rows = rows.take(pa.array(order))
        first = rows.slice(0, 1).to_pylist()[0]
        part, trips = Slice(first, depth), rows["trip"].to_numpy()
        for t in range(made):
            of = rows.filter(pa.array(trips == t))
            a, b, owned = (np.concatenate([np.zeros(0, kind), *(unpacked(x, kind) for x in of[c].to_pylist())]) for c, kind in (("a", np.int64), ("b", np.int64), ("owned", np.uint8)))
            part.learn(t, a, b, owned.astype(bool), trained)
        return first["slice"], part

    def with_totals(number: int) -> DataFrame:
        """The slices of a pass with all their totals so far."""
        back = [t.select("slice", "trip", "range", "a", "b", "owned", F.lit(None).cast("array<bigint>").alias("doc_ids"), *empty("ends", "hashes", "which")) for t in totals]
        return reduce(DataFrame.unionByName, back, own).where(F.pmod(F.xxhash64("slice"), F.lit(PASSES)) == number)

    def in_passes(part: Callable[[int], DataFrame], name: str) -> DataFrame:
        """All parts, each written before the next is begun, and its shuffle freed."""
        out = []
        for number in range(PASSES):
            out.append(written(part(number), name))
            free_shuffles(docs.sparkSession)
        return reduce(DataFrame.unionByName, out)

    def send_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from ask(Slice(row, depth), row["slice"], 0, ranges).to_batches()

    def send(trip: int) -> Callable[[pa.Table], pa.Table]:
        def asks(rows: pa.Table) -> pa.Table:
            number, part = known(rows, trip)
            return ask(part, number, trip, ranges)

        return asks

    totals: list[DataFrame] = []
    for trip in range(depth + 1):
        if trip:
            sent = in_passes(lambda k: with_totals(k).groupBy("slice").applyInArrow(send(trip), SENT), f"asked-{trip}")  # noqa: B023
            totals.append(in_passes(lambda k: sent.where(F.col("range") % PASSES == k).groupBy("range").applyInArrow(summed(trip, cost), TOTALS), f"totals-{trip}"))  # noqa: B023
            discard(docs.sparkSession, f"asked-{trip}")
        else:
            totals.append(written(parts.mapInArrow(send_first, SENT).groupBy("range").applyInArrow(summed(trip, cost), TOTALS), f"totals-{trip}"))
            free_shuffles(docs.sparkSession)
    words = totals[0].agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first().n

    def score(rows: pa.Table) -> pa.Table:
        return pa.table(known(rows, depth + 1)[1].scores(words, discount))

    out = in_passes(lambda k: with_totals(k).groupBy("slice").applyInArrow(score, SCORES), "scores")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
