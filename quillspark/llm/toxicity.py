"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, negation, reporting verb, quotation mark, other). Four small transducers read
them, each adding weights on its arcs: reported speech and negation take from an insult or a threat, a target nearby adds,
and a threat counts with its target only. Their composition is one table over reachable states. A clause's weight is that
of its path, a text's evidence the log-sum over its matched clauses, and a logistic curve makes a probability of it.

The insult lexicon (words and beginnings of words, with weights) and the curve are learned from labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.shared import bound_batches, text_slices, written

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
SYMBOLS = 7

# Closed word classes of English, German, French and Spanish, and seeds of the insult lexicon.
WORDS = {
    TARGET: "you your yours yourself u he she they him them her his their du dich dir dein deine ihr euch er sie tu toi te vous votre il elle ils eux usted ustedes tú ti ella ellos",
    NEGATION: "not no never isn't aren't wasn't don't nobody without nicht kein keine keiner nie niemals ne pas jamais non sans nunca jamás ni sin",
    REPORT: "said says say told called calls wrote claimed claims quoted reportedly sagte sagt sagten nannte schrieb dit disait appelé écrit prétend dijo dice llamó escribió",
    THREAT: "kill hurt murder destroy shoot stab strangle töten umbringen erschießen tuer assassiner matar asesinar",
}
SEEDS = "idiot moron imbecile stupid dumb loser scum bastard dummkopf trottel arschloch connard crétin salaud idiota imbécil estúpido"
BREAKS = "but aber mais pero"

#: Weights on arcs, in natural logarithms.
SEED_WEIGHT, DIRECTED, THREATENED, NEGATED, REPORTED = 5.0, 1.0, 5.0, -2.5, -2.0
#: Tokens within which a target, or a negation before, belongs to an insult or a threat.
NEAR, NEGATION_REACH = 4, 3
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]+|[\"“”«»]")
SHORTEST, LONGEST = 4, 8

Step = Callable[[tuple, int], tuple[tuple, float]]


def reported_speech(state: tuple, symbol: int) -> tuple[tuple, float]:
    """After a reporting verb, to the clause's end, and inside quotation marks."""
    told, quoted = state
    if symbol == REPORT:
        return (1, quoted), 0.0
    if symbol == QUOTE:
        return (told, 1 - quoted), 0.0
    return state, REPORTED if symbol in (INSULT, THREAT) and (told or quoted) else 0.0


def negation(state: tuple, symbol: int) -> tuple[tuple, float]:
    (left,) = state
    if symbol == NEGATION:
        return (NEGATION_REACH,), 0.0
    return (max(0, left - 1),), NEGATED if left and symbol in (INSULT, THREAT) else 0.0


def _meeting(marked: int, weight: float) -> Step:
    """Adds weight once for each `marked` symbol that has a target within NEAR tokens on either side."""

    def step(state: tuple, symbol: int) -> tuple[tuple, float]:
        target, waiting = state
        if symbol == TARGET:
            return (NEAR, 0), weight if waiting else 0.0
        after = (max(0, target - 1), max(0, waiting - 1))
        if symbol != marked:
            return after, 0.0
        return (after, weight) if target else ((after[0], NEAR), 0.0)

    return step


MACHINES: tuple[tuple[tuple, Step], ...] = (((0, 0), reported_speech), ((0,), negation), ((0, 0), _meeting(INSULT, DIRECTED)), ((0, 0), _meeting(THREAT, THREATENED)))


def compose(machines: tuple[tuple[tuple, Step], ...]) -> tuple[np.ndarray, np.ndarray]:
    """The product of transducers that read the same symbols, over reachable states: next state and arc weight by state and symbol; it starts in state 0."""
    start = tuple(s for s, _ in machines)
    number, todo, arcs = {start: 0}, [start], []
    for states in todo:
        row = []
        for symbol in range(SYMBOLS):
            moved = [step(s, symbol) for s, (_, step) in zip(states, machines, strict=True)]
            after = tuple(s for s, _ in moved)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], sum(w for _, w in moved)))
        arcs.append(row)
    table = np.array(arcs)
    return table[:, :, 0].astype(int), table[:, :, 1]


NEXT, WEIGHT = (x.tolist() for x in compose(MACHINES))
CLASS = {w: kind for kind, listed in WORDS.items() for w in listed.split()} | dict.fromkeys("\"“”«»", QUOTE)
SEED, BREAK = frozenset(SEEDS.split()), frozenset(BREAKS.split())


def patterns_of(word: str) -> list[str]:
    """The word, with an end mark, and its beginnings: what the lexicon's transducer may match."""
    return [word + "$", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


@dataclass
class Model:
    """Counts of training texts by pattern and label, and the curve: intercept, matched, evidence."""

    counts: dict[str, tuple[int, int]]
    toxic: int = 0
    clean: int = 0
    curve: tuple[float, float, float] = (-3.0, -1.0, 1.5)
    least_support: int = 3
    least_weight: float = 1.5

    def weight(self, toxic: int, clean: int, label: int | None = None) -> float:
        """Log ratio of a pattern's shares among toxic (less a standard error) and clean training texts, 0 where it is no insult.

        label: of the text at hand, whose own count is left out.
        """
        toxic, clean = toxic - (label == 1), clean - (label == 0)
        if toxic < self.least_support:
            return 0.0
        found = math.log((toxic - math.sqrt(toxic)) / (self.toxic + 1)) - math.log((clean + 1) / (self.clean + 1))
        return found if found >= self.least_weight else 0.0

    def insult(self, word: str, label: int | None = None) -> float:
        weights = [self.weight(*n, label) for p in patterns_of(word) if (n := self.counts.get(p))]
        return max([SEED_WEIGHT if word in SEED else 0.0, *weights])

    def read(self, text: str, label: int | None = None, known: dict[str, float] | None = None) -> tuple[float, int]:
        """Evidence of a text and the number of its matched clauses. known: weights of words met before, kept between texts."""
        tokens = TOKEN.findall(text.lower())
        known = {} if known is None or label is not None else known
        for word in set(tokens).difference(known):
            known[word] = self.insult(word, label) if word[0].isalpha() and word not in CLASS else 0.0
        if not any(known[w] or CLASS.get(w) == THREAT for w in set(tokens)):
            return 0.0, 0
        found, state, total, best = [], 0, 0.0, False
        for word in [*tokens, "."]:
            if word[0] in ".!?;\n" or word in BREAK:
                if best and total > 0:
                    found.append(total)
                state, total, best = 0, 0.0, False
                continue
            lexical = known[word]
            symbol = INSULT if lexical else CLASS.get(word, OTHER)
            gain = WEIGHT[state][symbol]
            # An arc never takes more than the insult brought.
            total += max(0.0, lexical + gain) if lexical else gain if gain > 0 or symbol != THREAT else 0.0
            best |= lexical > 0 or gain >= THREATENED + min(NEGATED, REPORTED)
            state = NEXT[state][symbol]
        if not found:
            return 0.0, 0
        top = max(found)
        return top + math.log(sum(math.exp(x - top) for x in found)), len(found)

    def score(self, evidence: float, clauses: int) -> float:
        a, matched, slope = self.curve
        z = a + (matched + slope * min(evidence, 12.0) if clauses else 0.0)
        return 1 / (1 + math.exp(-z))


def fit_curve(evidence: np.ndarray, clauses: np.ndarray, toxic: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression on (1, matched, evidence) by Newton steps, halved until they lower the loss; a slope that is not above zero gives way to the default."""
    matched = (clauses > 0).astype(float)
    x = np.stack([np.ones(len(toxic)), matched, np.minimum(evidence, 12.0) * matched], 1)
    default = np.array(Model.curve)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - toxic * z).sum() + ridge / 2 * ((b - default) ** 2).sum())

    b = default.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (toxic - p) - ridge * (b - default))
        while np.abs(step).max() > 1e-6 and not loss(b + step) < loss(b):
            step /= 2
        if np.abs(step).max() <= 1e-6:
            break
        b = b + step
    return tuple(map(float, b)) if b[2] > 0 else Model.curve


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic, text: about `most` labelled documents at most, by hash, without held-out ones and without near copies.

    Contradicting labels of an id count as toxic, of repeated ids one text is taken. Documents with one least hash of
    five-word passages count as copies, of which the smallest id stays.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(remainder(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    found = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, found)))
    words = F.split(F.col("text"), r"[\x20\x09-\x0D]+")
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda k: F.xxhash64(F.slice("w", k, 5)))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The ids are at most about `most` rows.
    sample = sample.join(F.broadcast(known.where(share)), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("w", words)
    sample = written(sample.select("doc_id", "toxic", "text", F.when(F.size("w") >= 5, F.array_min(shingles)).otherwise(F.xxhash64("text")).alias("sign")), "toxicity-sample")
    first = sample.groupBy("sign").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return sample.join(F.broadcast(first), "doc_id").select("doc_id", "toxic", "text")


def count_patterns(rows: DataFrame) -> DataFrame:
    """pattern, toxic, clean: training texts that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices([batch], "text", 4_000_000):
                by_label = (Counter(), Counter())
                for text, toxic in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True):
                    words = {w for w in TOKEN.findall(text.lower()) if w[0].isalpha()}
                    by_label[toxic == 1].update({p for w in words for p in patterns_of(w)})
                clean, toxic = by_label
                names = list(clean.keys() | toxic.keys())
                for k in range(0, len(names), 50_000):
                    some = names[k : k + 50_000]
                    yield pa.record_batch({"pattern": pa.array(some, pa.string()), "toxic": pa.array([toxic[p] for p in some], pa.int64()), "clean": pa.array([clean[p] for p in some], pa.int64())})

    each = rows.select("text", "toxic").mapInArrow(count, "pattern string, toxic long, clean long")
    return each.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, lexicon: int = 20_000) -> Model:
    """Fits lexicon and curve on at most about `most` labelled texts; the lexicon has at most `lexicon` patterns, those of the greatest weight.

    Each training text is weighed by a lexicon without its own counts, so the curve is not fitted on what was learned by heart.
    """
    bound_batches(docs.sparkSession)
    rows = training_rows(docs, labels, most)
    toxic, clean = (n or 0 for n in rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first())
    model = Model({}, toxic, clean)
    if not toxic or not clean:
        return model
    # What passes with a clean text's own count left out; most ever reaches the driver is `lexicon` rows.
    ratio = F.log((F.col("toxic") - F.sqrt("toxic")) / (toxic + 1)) - F.log(F.greatest("clean", F.lit(1)) / (clean + 1))
    found = count_patterns(rows).where(F.col("toxic") >= model.least_support).withColumn("ratio", ratio).where(F.col("ratio") >= model.least_weight)
    model.counts = {r.pattern: (r.toxic, r.clean) for r in found.orderBy(F.desc("ratio"), F.desc("toxic"), "pattern").limit(lexicon).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices([batch], "text", 4_000_000):
                got = [sent.value.read(t, int(y == 1)) for t, y in zip(part["text"].to_pylist(), part["toxic"].to_pylist(), strict=True)]
                yield pa.record_batch({"evidence": pa.array([e for e, _ in got], pa.float64()), "clauses": pa.array([n for _, n in got], pa.int64()), "toxic": part["toxic"]})

    weighed = rows.select("text", "toxic").mapInArrow(weigh, "evidence double, clauses long, toxic int").groupBy(F.round("evidence", 3).alias("evidence"), "clauses", (F.col("toxic") == 1).cast("int").alias("toxic")).count()
    seen = np.array([(r.evidence, r.clauses, r.toxic, r["count"]) for r in weighed.collect()])
    times = np.repeat(np.arange(len(seen)), seen[:, 3].astype(int))
    order = np.lexsort(seen[times, :3].T)
    model.curve = fit_curve(*seen[times][order, :3].T)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, evidence, clauses of each row of docs (doc_id, text; others are ignored), from whole texts alone.

    A null text is empty; a text without a matched clause, empty or not, has the curve's value there. Equal texts have equal
    scores; repeated rows and null ids stay. No documents: no rows.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for part in text_slices([batch], "text", 4_000_000):
                if len(known) > 200_000:
                    known = {}
                got = [sent.value.read(t or "", None, known) for t in part["text"].to_pylist()]
                yield pa.record_batch({"doc_id": part["doc_id"], "score": pa.array([sent.value.score(*x) for x in got], pa.float64()), "evidence": pa.array([e for e, _ in got], pa.float64()), "clauses": pa.array([n for _, n in got], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, evidence double, clauses long")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a null id counts as held out. See `score_texts` and `training_rows` for nulls, ties and empty tables."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_texts(docs, train(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "clauses")
