"""Quality rules: counts of whole texts, and perplexity bands under a modified Kneser-Ney model of each language."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, local_path, new_folder, text_slices, tidy, written
from quillspark.llm.tokens import drop_encoders
from quillspark.llm.words import code_points, mixed, numbered, owners, word_hashes, words_of

#: Symbols of the model: 0 white space, then code points below SINGLE, each as it is; any other is two symbols, a first from SINGLE on and
#: a second from 1 on. So no two code points fall together.
SYMBOLS, ORDER = 1 << 13, 4
SINGLE = SYMBOLS - math.ceil(0x110000 / (SYMBOLS - 1))
#: Languages that have the first slots in every task, and how many slots there are beside 0: codes of n-grams with their slots are longs.
LANGUAGES, SLOTS = ("de", "en", "es", "fr"), 2**63 // SYMBOLS**ORDER - 1
#: Bytes of text that are looked at at once: what is made of them takes some fifty times as much.
SLICE = 1_000_000
#: n-grams that a counting task holds, n-grams in a file of a model, and models whose discounts are broadcast.
HELD, FILE, BROADCAST_MODELS = 500_000, 1_000_000, 100_000


def symbol_table() -> np.ndarray:
    """The first symbol of each code point. All white space is one symbol, as words are told apart by any of it."""
    points = np.arange(0x110000, dtype=np.uint32)
    table = np.where(points < SINGLE, points, SINGLE + points // (SYMBOLS - 1)).astype(np.uint16)
    table[0], table[[9, 10, 11, 12, 13, 32]] = 32, 0
    return table


def symbols(points: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts' code points, and their offsets."""
    first, wide = table[points], points >= SINGLE
    if not wide.any():
        return first, ends
    after = np.concatenate([[0], np.cumsum(1 + wide)])
    out = np.repeat(first, 1 + wide)
    out[after[1:][wide] - 1] = 1 + points[wide] % (SYMBOLS - 1)
    return out, after[ends]


def ngrams(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER-grams of all texts, and len(texts) + 1 offsets.

    Runs of white space count once; a text begins after, and ends with, white space.
    """
    found, ends = symbols(*code_points(texts), table)
    n = len(ends) - 1
    pad = ORDER - 1
    stream = np.zeros(len(found) + n * (pad + 1) + pad, np.uint16)
    at = np.arange(len(found)) + np.repeat(np.arange(n) * (pad + 1) + pad, np.diff(ends))
    stream[at] = found
    real = np.zeros(len(stream), bool)
    real[at] = True
    last = ends[1:] + np.arange(1, n + 1) * (pad + 1) - 1  # the white space after each text
    real[last] = True
    text = np.zeros(len(stream), np.int64)
    text[at] = np.repeat(np.arange(n), np.diff(ends))
    text[last] = np.arange(n)
    repeated = np.zeros(len(stream), bool)
    repeated[1:] = (stream[1:] == 0) & (stream[:-1] == 0) & real[1:]
    keep = ~repeated
    stream, real, text = stream[keep], real[keep], text[keep]
    codes = stream.astype(np.int64)
    for back in range(1, ORDER):
        codes[back:] += stream[:-back].astype(np.int64) * SYMBOLS**back
    return codes[real], np.concatenate([[0], np.cumsum(np.bincount(text[real], minlength=n))])


def slots_of(languages: pa.Array, known: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """1 + the place in known; 0 for null."""
    found = pc.index_in(languages, value_set=pa.array(known, languages.type))
    return pc.add(pc.fill_null(found, -1), 1).to_numpy(zero_copy_only=False).astype(np.int64)


def with_new(known: tuple[str, ...], languages: pa.Array) -> tuple[str, ...]:
    """known, and the languages that it lacks after them."""
    return (*known, *(x for x in languages.unique().drop_null().to_pylist() if x not in known))


def models_of(known: tuple[str, ...]) -> pa.Array:
    """The name of each slot's model."""
    return pa.array(["", *known])


def model_name() -> Column:
    """Each value of lang has two models, and so has null: texts are dealt to two halves, copies to the same one, and scored by what the other half teaches."""
    half = F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(2)).cast("string")
    return F.concat(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")), F.lit("/"), half)


def other_half(model: Column) -> Column:
    return F.concat(F.substring(model, F.lit(1), F.length(model) - 1), F.when(model.endswith("0"), "1").otherwise("0"))


def base_passes(texts: pa.Array, min_words: int, max_repeat_percent: int) -> np.ndarray:
    """Whether each text passes the base rule (see quality)."""
    ends, words = words_of(texts)
    n_words = np.diff(ends)
    return (n_words >= min_words) & (100 * repeat_words(owners(ends), numbered(words)[0], len(texts)) <= max_repeat_percent * n_words)


def ngram_counts(batches: Iterator[pa.RecordBatch], ranks: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """model, code, n, passing, good over all batches (text, lang): how often an n-gram occurs, in texts of rank 1 or 2, and of rank 2 (all, if not told).

    code: slot * SYMBOLS**ORDER + n-gram. What is held goes on its way at HELD n-grams, or when a task has met more languages than there are slots.
    """
    drop_encoders()
    table, size = symbol_table(), SYMBOLS**ORDER

    def counts() -> Iterator[pa.RecordBatch]:
        names = models_of(known)
        for k in range(0, len(held), 100_000):
            some, n = held[k : k + 100_000], times[k : k + 100_000]
            yield pa.RecordBatch.from_pydict({"model": names.take(pa.array(some // size)), "code": some, "n": n.sum(axis=1), "passing": n[:, 1] + n[:, 2], "good": n[:, 2].copy()})

    known, held, times = LANGUAGES, np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    for batch in text_slices(batches, "text", SLICE):
        more = with_new(known, batch["lang"])
        if len(more) > SLOTS or len(held) > HELD:
            yield from counts()
            held, times, more = held[:0], times[:0], with_new(LANGUAGES, batch["lang"])
        known = more
        codes, ends = ngrams(batch["text"], table)
        codes += np.repeat(slots_of(batch["lang"], known) * size, np.diff(ends))
        rank = np.repeat(np.full(batch.num_rows, 2) if ranks is None else ranks(batch), np.diff(ends))
        found = [np.unique(codes[rank == k], return_counts=True) for k in range(3)]
        both, at = np.unique(np.concatenate([held, *(x for x, _ in found)]), return_inverse=True)
        after, first = np.zeros((len(both), 3), np.int64), len(held)
        after[at[:first]] = times
        for k, (x, n) in enumerate(found):
            after[at[first : first + len(x)], k] += n
            first += len(x)
        held, times = both, after
    yield from counts()


def count_ngrams(docs: DataFrame, labels: DataFrame | None, min_words: int, max_repeat_percent: int) -> DataFrame:
    """model, code, n: all n-grams of all docs by the model that scores them, and how often each occurs in the docs that it learns from (see quality).

    Up to 1,000,000 good rows, counted, are broadcast, so that no text is shuffled.
    """
    bound_batches(docs.sparkSession)

    def ranks(batch: pa.RecordBatch) -> np.ndarray:
        return base_passes(batch["text"], min_words, max_repeat_percent) * (1 + batch["good"].to_numpy(zero_copy_only=False))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from ngram_counts(batches, ranks)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), model_name().alias("lang"), F.lit(False).alias("good"))
    if labels is not None:
        good = good_rows(labels)
        texts = texts.drop("good").join((F.broadcast(good) if good.count() <= 1_000_000 else good).withColumn("good", F.lit(True)), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    found = texts.select("text", "lang", "good").mapInArrow(tidy(count), "model string, code long, n long, passing long, good long")
    each = found.select(F.col("model").alias("of"), F.pmod("code", F.lit(SYMBOLS**ORDER)).alias("code"), "passing", "good").groupBy("of", "code").agg(F.sum("passing").alias("passing"), F.sum("good").alias("good"))
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(F.struct(F.col("of").alias("model"), zero.alias("passing"), zero.alias("good")), F.struct(other_half(F.col("of")).alias("model"), "passing", "good")))
    grams = written(each.select("code", sides.alias("x")).groupBy("x.model", "code").agg(F.sum("x.passing").alias("passing"), F.sum("x.good").alias("good")), "grams")
    models = written(grams.groupBy("model").agg((F.sum("good") > 0).alias("labelled")), "models")
    return grams.join(by_count(models), "model").select("model", "code", F.when(F.col("labelled"), F.col("good")).otherwise(F.col("passing")).alias("n"))


def by_count(models: DataFrame) -> DataFrame:
    """A row a model, to be broadcast where there are few."""
    return F.broadcast(models) if models.count() <= BROADCAST_MODELS else models


def discounts(counts: np.ndarray) -> np.ndarray:
    """The discounts for counts of 0, 1, 2 and more, from how many n-grams occur 1 to 4 times."""
    n = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(float)
    if (n == 0).any():
        return np.array([0, 0.5, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    found = np.array([k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)])
    return np.concatenate([[0], np.clip(found, 0.05, np.array([1, 2, 3]) - 0.05)])


class KneserNey:
    """Interpolated modified Kneser-Ney probabilities in sorted arrays of n-gram codes: in one process what `probabilities` works out by joins."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        """codes ascend; counts are those of the corpus. Shorter n-grams count the symbols seen before them."""
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        raw = [(codes, counts)]
        for order in range(ORDER - 1, 0, -1):
            longer, size = raw[0][0], SYMBOLS**order
            raw.insert(0, np.unique(longer // (size * SYMBOLS) * size + longer % size, return_counts=True))
        for order, (keys, n) in enumerate(raw, 1):
            off, kind = discounts(n), np.minimum(n, 3)
            contexts, inverse = np.unique(keys // SYMBOLS, return_inverse=True)
            total = np.bincount(inverse, n, len(contexts))
            back = np.bincount(inverse, off[kind], len(contexts)) / np.maximum(total, 1)
            lower = self.probability(keys // SYMBOLS**order * SYMBOLS ** (order - 1) + keys % SYMBOLS ** (order - 1), order - 1)
            self.levels.append((keys, (n - off[kind]) / total[inverse] + back[inverse] * lower, contexts, back))

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of the last symbol of each key after those before it."""
        if not order:
            return np.full(len(keys), 1 / SYMBOLS)
        known, values, contexts, back = self.levels[order - 1]
        if not len(known):
            return np.full(len(keys), 1 / SYMBOLS)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        out = values[at]
        miss = keys[~hit]
        if len(miss):
            lower = self.probability(miss // SYMBOLS**order * SYMBOLS ** (order - 1) + miss % SYMBOLS ** (order - 1), order - 1)
            ctx = miss // SYMBOLS
            at = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            out[~hit] = lower * np.where(contexts[at] == ctx, back[at], 1)
        return out


def probabilities(counts: DataFrame) -> DataFrame:
    """model, code, p: interpolated modified Kneser-Ney probability of each n-gram's last symbol after the others, from counts (model, code, n).

    n-grams of count 0 get theirs from shorter ones. Shorter n-grams count the symbols seen before them. A context has at most SYMBOLS n-grams
    and a shorter n-gram ends at most SYMBOLS longer ones, so no window or key grows with the corpus.
    """
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        shorter = levels[0].groupBy("model", F.pmod("code", F.lit(SYMBOLS**order)).alias("code")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))
        levels.insert(0, written(shorter, "grams"))
    times = lambda k: F.sum((F.col("n") == k).cast("double"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    off = lambda k: F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05))
    known = F.least("n1", "n2", "n3", "n4") > 0
    each = [F.when(known, off(k)).otherwise(usual).alias(f"off{k}") for k, usual in ((1, 0.5), (2, 0.75), (3, 0.75))]
    lower = None
    for order, grams in enumerate(levels, 1):
        of = written(grams.groupBy("model").agg(*(times(k).alias(f"n{k}") for k in (1, 2, 3, 4))).select("model", *each), "discounts")
        off_n = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("off1")).when(F.col("n") == 2, F.col("off2")).otherwise(F.col("off3"))
        rows = grams.join(by_count(of), "model").select("model", "code", "n", off_n.alias("off"))
        context = Window.partitionBy("model", F.floor(F.col("code") / SYMBOLS) if order > 1 else F.lit(0))
        rows = rows.withColumn("total", F.sum("n").over(context)).withColumn("back", F.sum("off").over(context))
        if lower is None:
            rows = rows.withColumn("lower", F.lit(1 / SYMBOLS))
        else:
            rows = rows.withColumn("shorter", F.pmod("code", F.lit(SYMBOLS ** (order - 1)))).join(lower.select("model", F.col("code").alias("shorter"), F.col("p").alias("lower")), ["model", "shorter"])
        lower = rows.select("model", "code", F.when(F.col("total") > 0, (F.col("n") - F.col("off") + F.col("back") * F.col("lower")) / F.col("total")).otherwise(F.col("lower")).alias("p"))
    return lower


def keys_of(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A number of 63 bits for each n-gram and the hash of its model."""
    return (mixed(mixed(codes) + of) >> np.uint64(1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """log2 probabilities of n-grams in files of sorted keys, by ranges of keys; tasks map them into memory and read what they look up."""

    folder: str
    files: int

    def file_of(self, keys: np.ndarray) -> np.ndarray:
        """Keys of 63 bits are dealt by their first 31 bits, in order."""
        return (keys >> 32) * self.files >> 31

    def path(self, file: int, what: str) -> str:
        return f"{local_path(self.folder)}/{what}-{file}.npy"

    def save(self, file: int, keys: np.ndarray, values: np.ndarray) -> None:
        """A file is whole or not there, and the same from each attempt at a task."""
        for what, array in (("keys", keys), ("values", values)):
            part = f"{self.path(file, what)}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                np.save(out, array)
            os.replace(part, self.path(file, what))

    def opened(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function that looks up keys, ascending; all must be there."""
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def look(keys: np.ndarray) -> np.ndarray:
            out, file = np.empty(len(keys), np.float32), self.file_of(keys)
            starts = np.flatnonzero(np.diff(file, prepend=-1))
            for first, last in zip(starts, [*starts, len(keys)][1:], strict=True):
                k = int(file[first])
                if k not in maps:
                    maps[k] = tuple(np.load(self.path(k, what), mmap_mode="r") for what in ("keys", "values"))
                known, values = maps[k]
                at = np.minimum(np.searchsorted(known, keys[first:last]), len(known) - 1)
                if (known[at] != keys[first:last]).any():
                    raise RuntimeError("an n-gram of the documents is not in the model")
                out[first:last] = values[at]
            return out

        return look


def train(docs: DataFrame, labels: DataFrame | None = None, min_words: int = 50, max_repeat_percent: int = 50) -> Model:
    """Models of all languages (see quality); they have the n-grams of all docs. Nothing of it passes through the driver."""
    spark = docs.sparkSession
    counts = written(count_ngrams(docs, labels, min_words, max_repeat_percent), "grams")
    folder = new_folder(spark, "model")
    model = Model(folder, max(1, math.ceil(counts.count() / FILE)))
    os.makedirs(local_path(folder), exist_ok=True)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, names = numbered(batch["model"])
            keys = keys_of(batch["code"].to_numpy(), word_hashes(names)[which])
            yield pa.RecordBatch.from_pydict({"file": model.file_of(keys), "key": keys, "value": np.log2(batch["p"].to_numpy()).astype(np.float32)})

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                table, file = pa.Table.from_batches(held), held[0]["file"][0].as_py()
                model.save(file, table["key"].to_numpy(), table["value"].to_numpy())
                held.clear()
                yield pa.RecordBatch.from_pydict({"file": [file], "n": [table.num_rows]})

        for batch in batches:
            file = batch["file"].to_numpy()
            starts = np.flatnonzero(np.diff(file, prepend=-1)).tolist()
            for first, last in zip(starts, [*starts, batch.num_rows][1:], strict=True):
                if held and held[0]["file"][0].as_py() != file[first]:
                    yield from done()
                held.append(batch.slice(first, last - first))
        yield from done()

    rows = probabilities(counts).mapInArrow(keyed, "file long, key long, value float")
    rows.repartition("file").sortWithinPartitions("file", "key").mapInArrow(save, "file long, n long").agg(F.sum("n")).first()
    return model


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    ends, words = words_of(texts)
    doc = owners(ends)
    filled = pc.fill_null(texts, "")
    lines = pc.split_pattern(filled, "\n")
    line_ends = np.asarray(lines.offsets, np.int64)
    line, distinct = numbered(lines.flatten())
    worded = pc.match_substring_regex(distinct, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)[line] if len(distinct) else np.zeros(0, bool)
    line_doc = owners(line_ends - line_ends[0])
    first = np.unique(line_doc[worded] * (len(distinct) + 1) + line[worded]) // (len(distinct) + 1)
    return {
        "n_words": np.diff(ends),
        "word_chars": np.bincount(doc, pc.utf8_length(words).to_numpy(zero_copy_only=False), n).astype(np.int64),
        "n_symbols": pc.count_substring_regex(filled, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": np.bincount(line_doc[worded], minlength=n) - np.bincount(first, minlength=n),
        "n_repeat_words": repeat_words(doc, numbered(words)[0], n),
    }


def repeat_words(doc: np.ndarray, word: np.ndarray, n: int, width: int = 3) -> np.ndarray:
    """For each text, the words in windows of `width` words that occur twice or more in it."""
    if len(word) < width:
        return np.zeros(n, np.int64)
    last = len(word) - width + 1
    window = word[:last]
    for k in range(1, width):
        window = np.unique(window * (word.max() + 1) + word[k : last + k], return_inverse=True)[1]
    inside = doc[:last] == doc[width - 1 :]
    _, inverse, counts = np.unique(doc[:last][inside] * (window.max() + 1) + window[inside], return_inverse=True, return_counts=True)
    marked = np.zeros(len(word), bool)
    for k in range(width):
        marked[np.flatnonzero(inside)[counts[inverse] > 1] + k] = True
    return np.bincount(doc[marked], minlength=n)


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, text_key, the counts of text_counts, and log2 of the perplexity a symbol (null for no word). docs: those of train."""
    bound_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, size, look = symbol_table(), SYMBOLS**ORDER, model.opened()
        for batch in text_slices(batches, "text", SLICE):
            known = with_new((), batch["model"])
            codes, ends = ngrams(batch["text"], table)
            codes += np.repeat(slots_of(batch["model"], known) * size, np.diff(ends))
            found, at = np.unique(codes, return_inverse=True)  # each distinct n-gram of the slice is looked up once
            keys = keys_of(found % size, word_hashes(models_of(known))[found // size])
            order = np.argsort(keys)
            values = np.empty(len(found), np.float32)
            values[order] = look(keys[order])
            counts = text_counts(batch["text"])
            sums = np.concatenate([[0], np.cumsum(values[at].astype(float))])
            bits = (sums[ends[:-1]] - sums[ends[1:]]) / np.maximum(np.diff(ends), 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "lang": batch["lang"], "text_key": batch["text_key"], **counts, "log2_perplexity": pa.array(bits, mask=counts["n_words"] == 0)})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string"), model_name().alias("model"), F.xxhash64("text", "lang").alias("text_key"))
    return texts.mapInArrow(score, "doc_id long, lang string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log2_perplexity double")


def shares(bins: DataFrame, keys: list[str], loss: float, parts: int) -> DataFrame:
    """For each of keys: rows, and for each side the first bin (over parts) up to which all but a share of `loss` of n lie."""
    w = Window.partitionBy(*keys, "side")
    share = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("of", F.sum("n").over(w))
    at = lambda side: (F.min(F.when((F.col("side") == side) & (F.col("upto") >= (1 - loss) * F.col("of")), F.col("bin"))) / parts).alias(side)
    return share.groupBy(*keys).agg(at("down"), at("up"), F.max("of").alias("rows"))


def bands(scored: DataFrame, good: DataFrame | None, loss: float, width: float, least: int = 400, parts: int = 512) -> DataFrame:
    """For each lang the lowest and highest log2 perplexity that pass.

    Both lie beyond the quartiles of all texts with 50 words, on a scale of 1 / parts bits, by a number of distances between the
    quartiles (0.05 bits at least): by those that leave out a share of `loss` of the good rows (doc_id) of that
    lang, below and above; with fewer than `least` of these, of all langs; with fewer still, or no good ones, by
    `width`. It is 1 to `width` in any case. Nothing depends on partitions.
    """
    long = scored.where("n_words >= 50")
    histogram = long.groupBy("lang", F.floor(F.col("log2_perplexity") * parts).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    share = histogram.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("of", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("of"), F.col("bin")))
    q = share.groupBy(F.col("lang").alias("of")).agg((at(0.25) / parts).alias("q1"), (at(0.75) / parts).alias("q3")).withColumn("spread", F.greatest(F.col("q3") - F.col("q1"), F.lit(0.05)))
    if good is None:
        wide = q.withColumn("down", F.lit(width)).withColumn("up", F.lit(width))
    else:
        # Distances are counted on a scale of 1 / parts as well, so that any number of good rows can be looked at.
        beyond = long.join(good, "doc_id").join(q, F.col("lang").eqNullSafe(F.col("of")))
        distances = {"down": F.col("q1") - F.col("log2_perplexity"), "up": F.col("log2_perplexity") - F.col("q3")}
        sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.ceil(d / F.col("spread") * parts).alias("bin")) for k, d in distances.items())))
        bins = beyond.select(F.col("lang").alias("in"), sides.alias("x")).groupBy("in", "x.side", "x.bin").agg(F.count("*").alias("n"))
        one = shares(bins, ["in"], loss, parts).where(F.col("rows") >= least)
        every = shares(bins.groupBy("side", "bin").agg(F.sum("n").alias("n")), [], loss, parts).first()
        edge = lambda k: F.least(F.greatest(F.coalesce(k, F.lit(every[k] if (every.rows or 0) >= least else width)), F.lit(1.0)), F.lit(width)).alias(k)
        wide = q.join(one, F.col("of").eqNullSafe(F.col("in")), "left").select("of", "q1", "q3", "spread", edge("down"), edge("up"))
    return wide.select(F.col("of").alias("lang"), (F.col("q1") - F.col("down") * F.col("spread")).alias("lowest"), (F.col("q3") + F.col("up") * F.col("spread")).alias("highest"))


def good_rows(labels: DataFrame) -> DataFrame:
    """doc_id of all labelled good documents."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def quality(docs: DataFrame, labels: DataFrame | None = None, loss: float = 0.005, width: float = 4.0, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The verdict on each row of docs (doc_id, text, lang; other columns are ignored).

    base_failed: fewer than min_words words, or too many words in repeated windows. kept: not
    base_failed, and the perplexity lies in the band of its lang (see bands); null lang is a language of its own.
    labels (doc_id, quality) widen or narrow the bands: all good rows are looked at. A lang has two models, and each scores
    the half of its texts (by their hash) that it has not learned from: it learns from the other half's good rows that
    are not base_failed; where there are none, from all that are not, so not from junk.
    Null and empty texts have no words and fail; repeated rows are judged each, and alike.
    No documents: no rows.
    """
    scored = written(measure(docs, train(docs, labels, min_words, max_repeat_percent)), "quality")
    limits = bands(scored, None if labels is None else good_rows(labels), loss, width)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = scored.join(limits.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    inside = F.col("log2_perplexity").between(F.col("lowest"), F.col("highest"))
    return judged.withColumn("base_failed", base).withColumn("kept", ~base & F.coalesce(inside, F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """docs without the rows that quality() rejects; rows are matched by doc_id, text and lang.

    Up to 1,000,000 rejected rows, counted, are broadcast, whatever their files' size, so that no text is shuffled.
    """
    out = written(quality(docs, labels).where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "rejected")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string"), F.col("lang").cast("string")) == F.col("__key"))
    return docs.join(F.broadcast(out) if out.count() <= 1_000_000 else out, same, "left_anti")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")
