"""Operators of the subpackage llm against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, jaccard_join, line_dedup, packing, pii, quality, registry, suffix_tree, token_files, url_filter, warc
from quillspark.llm.shared import new_folder
from quillspark.llm.tokens import Encoder, shared_encoder, tokenizer_path
from quillspark.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, extra string"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    base = words(120, 1)
    near = base.copy()
    near[60] = "changed"
    long = " ".join(words(3000, 2))
    return [None, "", "  \n ", "one two", "One TWO", " ".join(base), " ".join(near), " ".join(base), "a\n" * 60, long, "x " * 80, "Ünï çödé — 日本語 テスト.", " ".join(words(130, 3)) + "\n" + " ".join(words(20, 4)), "\n".join([" ".join(words(20, 4)), " ".join(words(20, 4)[:-1])])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k % 3 else None, "x") for k, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_counting_ngrams_holds_little_beside_a_slice(monkeypatch):
    """A task held counters of all possible n-grams (102 MB in five languages) on top of what its worker had kept from packing."""
    shared_encoder(tokenizer_path())
    monkeypatch.setattr(quality, "SLICE", 4000)
    texts = [" ".join(words(60, k)) for k in range(200)] + [None, ""]
    langs = [("de", "en", "es", "fr", None)[k % 5] for k in range(len(texts))]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 50], pa.string()), "lang": pa.array(langs[k : k + 50], pa.string())}) for k in range(0, len(texts), 50)]
    want = collections.Counter()
    for t, lang in zip(texts, langs, strict=True):
        codes, _ = quality.ngrams(pa.array([t], pa.string()), quality.symbol_table())
        want.update((codes + quality.slots_of(pa.array([lang], pa.string()))[0] * quality.SYMBOLS**quality.ORDER).tolist())
    tracemalloc.start()
    try:
        got = list(quality.ngram_counts(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {k: n for b in got for k, n in zip(b["code"].to_pylist(), b["n"].to_pylist(), strict=True)} == want
    assert peak < 40_000_000 and shared_encoder.cache_info().currsize == 0


def test_encoder_keeps_the_pieces_that_are_met_again(monkeypatch):
    """A full cache forgot all its pieces; now those of every text are encoded once, and rare ones still go."""
    from tokenizers import Tokenizer

    e, library, asked = Encoder(tokenizer_path(), 60), Tokenizer.from_file(tokenizer_path()), collections.Counter()
    encoded = e._encoded
    monkeypatch.setattr(e, "_encoded", lambda pieces: asked.update(pieces) or encoded(pieces))
    for k in range(40):
        text = " ".join(f"common{n} rare{k}x{n}" for n in range(20))
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(e.known) <= 100
    assert {asked[f" common{n}".encode()] for n in range(1, 20)} == {1}


def test_encoder_equals_the_library(texts):
    from tokenizers import Tokenizer

    e = Encoder(tokenizer_path())
    odd = [*texts, "it's John's. 'tis", " a", "a ", "a  b\n\nc", "\x1c a\x1f b", "×. ÷, x", "a\u0085b　c", "don't!'s\t\tx"]
    odd += ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext"]
    library = Tokenizer.from_file(tokenizer_path())
    for _ in range(2):
        ids, ends = e.encode(pa.array(odd))
        for k, t in enumerate(odd):
            assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_token_files(spark, docs, none, texts):
    e = Encoder(tokenizer_path())
    folder = new_folder(spark, "t")
    token_files.write_token_files(docs, folder)
    start = 0
    for r, t in zip(token_files.read_token_files(spark, folder).orderBy("doc_id").collect(), texts, strict=True):
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    folder = new_folder(spark, "t")
    token_files.write_token_files(none, folder)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_null_id_has_no_place_in_token_files(spark, tmp_path):
    with pytest.raises(ValueError, match="doc_id"):
        token_files.write_token_files(spark.createDataFrame([(None, "a")], "doc_id long, text string"), f"file://{tmp_path}/ids")


def test_packing(docs, none, texts):
    e = Encoder(tokenizer_path())
    got = packing.pack(docs).collect()
    fill, seen = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.array([*e.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
        seen[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    assert set(seen) == set(range(len(texts)))
    for parts in [*seen.values(), *fill.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(n for _, n in x) <= 2048 for x in fill.values())
    assert packing.pack(none).count() == 0


def test_patterns_cover_with_little_waste():
    r = np.random.default_rng(5)
    sizes, demand = np.unique(r.integers(1, 129, 20_000), return_counts=True)
    patterns, used = packing.cutting_patterns(sizes, demand, 128)
    assert (patterns @ sizes <= 128).all() and (used @ patterns >= demand).all()
    assert used.sum() <= 1.01 * math.ceil((sizes * demand).sum() / 128) + 2


def test_quality_counts(docs, none, texts):
    for r in quality.quality(docs).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        marked = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality(none).count() == 0


def test_kneser_ney_sums_to_one():
    table = quality.symbol_table()
    codes, _ = quality.ngrams(pa.array([" ".join(words(400, 7)), "", None]), table)
    model = quality.KneserNey(*np.unique(codes, return_counts=True))
    for context in np.unique(codes // quality.SYMBOLS)[:20]:
        assert abs(model.probability(context * quality.SYMBOLS + np.arange(quality.SYMBOLS)).sum() - 1) < 1e-9


def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_groups(spark, none):
    r = random.Random(9)
    made = [None, "", "one", "One", "one two"]
    for k in range(40):
        base = words(r.randint(6, 200), 100 + k)
        made.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            x = base.copy()
            for _ in range(r.randint(0, 6)):
                x[r.randrange(len(x))] = "w" + str(r.randint(0, 9))
            made.append(" ".join(x))
    shared = words(60, 999)  # a passage that many sets share: crowds of one signature
    made += [" ".join(shared + words(r.randint(5, 70), 2000 + k)) for k in range(90)]
    sets = [shingles(t) for t in made]
    parent = list(range(len(made)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(made)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_groups(frame).collect()}
    assert got == {k: (len(sets[k]), root(k)) for k in range(len(made))}
    assert jaccard_join.similar_groups(none).count() == 0


def test_signatures_are_shared_by_all_similar_sets():
    r = np.random.default_rng(3)
    for size in (2, 3, 4, 7, 8, 15, 16, 31, 64, 200):
        for _ in range(20):
            x = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
            y = x.copy()
            for _ in range(r.integers(0, max(2, size // 7))):
                y = y[1:] if r.random() < 0.5 else np.append(y, np.uint64(r.integers(0, 2**63)))
            same = len(np.intersect1d(x, y))
            if 100 * same >= 75 * (len(x) + len(y) - same):
                owner, tag, value, need = jaccard_join.signatures(np.array([0, len(x), len(x) + len(y)]), np.concatenate([np.sort(x), np.sort(y)]))
                bands = jaccard_join.band_of(np.array([len(x), len(y)]))
                tags = [0, 0] if bands[0] == bands[1] else [int(bands[0] < bands[1]), int(bands[1] < bands[0])]
                shared = np.intersect1d(value[(owner == 0) & (tag == tags[0])], value[(owner == 1) & (tag == tags[1])]).size
                assert shared >= max(need[tags[0], 0], need[tags[1], 1]) >= 1


def test_near_copies_with_common_passages_and_repeated_ids(spark):
    r = random.Random(4)
    base, passage = words(160, 50), words(60, 51)
    made = [" ".join(base)] * 60
    for k in range(120):  # near copies, some of them too far from all others
        x = base.copy()
        for _ in range(r.randint(1, 14)):
            x[r.randrange(len(x))] = f"new{r.randint(0, 3000)}"
        made.append(" ".join(x))
    made += [" ".join(words(r.randint(20, 90), 600 + k) + passage) for k in range(120)]
    rows = [(k - 5 if k < 300 else k - 150, t) for k, t in enumerate(made + made[40:60])] + [(None, made[0]), (2**62 + 7, made[100])]
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    at = {}
    for a, (doc_id, _) in enumerate(rows):
        for b in [at.setdefault(doc_id, a)] if doc_id is not None else []:
            parent[root(a)] = root(b)
    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    want = sorted((str(d), len(s), str(None if d is None else least[root(k)])) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    frame = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], "doc_id long, text string, component_id string, size int, node int").repartition(6)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.similar_groups(frame).collect())
    assert got == want


def test_decontamination_matches_sql_and_edges(spark, none):
    item = " ".join(words(30, 50))
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "")], "item_id long, text string")
    frame = spark.createDataFrame([(0, None), (1, ""), (2, item.upper()), (3, "x, Short; ITEM! " + " ".join(words(60, 51))), (4, " ".join(item.split()[3:16])), (5, " ".join(item.split()[3:15]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(frame, bench).collect()}
    assert got == {0: (0, 0, 0, False), 1: (0, 0, 0, False), 2: (30, 30, 1, True), 3: (63, 2, 1, False), 4: (13, 13, 1, True), 5: (12, 0, 0, False)}
    assert decontamination.contamination(frame, bench.limit(0)).where("contaminated").isEmpty()
    assert decontamination.contamination(none, bench).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontamination.proximity(frame, bench).collect()} >= {(2, "1"), (3, "2")}


def test_texts_under_one_item_id_are_each_looked_for(spark, tmp_path):
    a, b, absent, c = (" ".join(words(20, seed)) for seed in (70, 71, 72, 73))
    gone = " ".join(f"absent{w}" for w in absent.split())
    bench = [(1, a), (1, b), (1, gone), (None, c), (None, gone), (2, a), (2, a)]
    docs = [(0, a), (1, b), (2, c), (3, f"{a} and {b}"), (4, " ".join(a.split()[:13])), (5, " ".join(b.split()[7:])), (6, f"{c} {a}"), (7, gone.replace("absent", "other"))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in registry.queries()["op6_decontamination"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == set(con.execute(registry.oracle_sql()["op6_decontamination"]).fetchall())
    assert {r[0]: (r[2], r[3]) for r in got} == {0: (20, 2), 1: (20, 1), 2: (20, 0), 3: (40, 2), 4: (13, 2), 5: (13, 1), 6: (40, 2), 7: (0, 0)}
    near = decontamination.proximity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in near.collect()} >= {(0, "1"), (0, "2"), (1, "1"), (2, None)}


def test_suffix_tree_base_scores(docs, none, texts):
    rows = {k: [*WORD.findall(lower(t)), None] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in rows}
    c = collections.Counter(w for k, x in rows.items() if not held[k] for w in x)
    n, v = sum(c.values()), len(c)
    for r in suffix_tree.scores(docs.unionByName(docs)).collect():
        x = rows[r.doc_id]
        want = sum(math.log10((2 * c[w] + 1) / (2 * n + v + 1)) for w in x)
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(x) and r.n_known == sum(w in c for w in x) and r.train_tokens == 2 * n
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want)) and r.score < 0
    assert suffix_tree.scores(none).count() == 0


def tree_by_hand(rows, held, depth, cost, discount):
    """Scores from plain counters: context, as a tuple of words before a token, to the counts of its next tokens."""
    tree = collections.defaultdict(collections.Counter)
    for k, x in rows.items():
        for i, w in enumerate(x):
            for d in range(min(depth, i + 1) + 1):
                tree[("", *x)[i + 1 - d : i + 1]][w] += not held[k]
    tree = {c: +n for c, n in tree.items()}
    root, total = tree[()], sum(tree[()].values())

    def kept(c):
        if not c:
            return True
        own, of, less = tree.get(c, {}), sum(tree.get(c, {}).values()), tree.get(c[1:], {})
        gain = sum(n * math.log(n / of * sum(less.values()) / less[w]) for w, n in own.items())
        return of >= 2 and kept(c[1:]) and gain >= cost * len(own) - 1e-5

    def probability(c, w):
        if not c:
            return (root[w] + 1) / (total + len(root) + 1)
        own, of = tree[c], sum(tree[c].values())
        return max(own[w] - discount, 0) / of + discount * len(own) / of * probability(c[1:], w)

    out = {}
    for k, x in rows.items():
        before = ("", *x)
        longest = lambda i: next(before[i + 1 - d : i + 1] for d in range(min(depth, i + 1), -1, -1) if kept(before[i + 1 - d : i + 1]))  # noqa: E731, B023
        out[k] = sum(math.log10(probability(longest(i), w)) for i, w in enumerate(x))
    return out


@pytest.mark.parametrize(("depth", "cost", "cut"), [(2, 1.0, 6_000_000), (3, 2.5, 900), (0, 1.0, 900)])
def test_suffix_tree_equals_counting_by_hand(spark, texts, depth, cost, cut, monkeypatch):
    r = random.Random(5)
    made = [*texts, *(" ".join(r.choice(["a b c", "a b d", "e", "f g", "b c"]) for _ in range(r.randint(1, 40))) for _ in range(60))]
    made += made[20:24] + [texts[9]]
    rows = {k: [*WORD.findall(lower(t)), None] for k, t in enumerate(made)}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in rows}
    want = tree_by_hand(rows, held, depth, cost, 0.75)
    monkeypatch.setattr(suffix_tree, "SLICE", cut)
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").withColumn("slice", F.lit("clash")).repartition(3)
    monkeypatch.setattr(suffix_tree, "TOKENS_A_RANGE", 700)
    got = {x.doc_id: x for x in suffix_tree.scores(frame, depth, cost).collect()}
    assert set(got) == set(want)
    for k, x in got.items():
        assert abs(x.score - want[k]) < 1e-5 * max(1, abs(want[k])), k
        assert abs(x.score_per_token * x.n_tokens - x.score) < 1e-6


def test_suffix_tree_without_training_and_without_ids(spark):
    lone = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    got = suffix_tree.scores(spark.createDataFrame([(lone, "a b"), (lone, None)], "doc_id long, text string")).collect()
    assert sorted((x.n_tokens, x.n_known, x.train_tokens, x.score) for x in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    nulls = suffix_tree.scores(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "")], "doc_id long, text string")).collect()
    assert sorted(x.n_tokens for x in nulls) == [1, 3, 3] and all(x.score < 0 for x in nulls)


def test_lines(spark, none):
    a, b = " ".join(words(20, 60)), " ".join(words(20, 61))
    less, swapped = " ".join(a.split()[1:]), " ".join(["other", *a.split()[1:]])
    frame = spark.createDataFrame([(1, f"{a}\nshort\nshort"), (2, f"{b}\n{less}\n{swapped}"), (3, a), (4, None), (5, ""), (6, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == {1: (f"{a}\nshort\nshort", 3, 0), 2: (b, 3, 2), 3: ("", 1, 1), 4: (None, 1, 0), 5: ("", 1, 0), 6: ("short", 1, 0)}
    assert line_dedup.dedup_lines(none).count() == 0


def test_short_lines_that_repeat_go(spark, tmp_path):
    import corpus_pipeline

    r, seen, want = random.Random(12), set(), {}
    made = [None, "", "  \n\n ", "home", "home\n\nhome\n home ", "a b c d e f g\na b c d e f x\na  b c d e f g"]
    made += ["\n".join(" ".join(r.choice("uvw") for _ in range(r.randint(0, 7))) for _ in range(r.randint(1, 6))) for _ in range(40)]
    for k, t in enumerate(made):
        kept = []
        for line in (t or "").split("\n"):
            w = tuple(WORD.findall(line))
            if not w or w not in seen:
                kept.append(line)
            seen.add(w)
        n = len((t or "").split("\n"))
        want[k] = (t if len(kept) == n else "\n".join(kept), n, n - len(kept))
    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: (x.text, x.n_lines, x.n_dropped) for x in registry.queries()["op8_line_dedup"](spark, str(tmp_path)).collect()} == want
    left = {k: t for k, (t, _, dropped) in want.items() if not dropped or WORD.search(t)}
    assert {x.doc_id: x.text for x in corpus_pipeline.line_dedup(spark, frame, str(tmp_path)).collect()} == left


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for k, x in enumerate(d)) % 10 == 0


#: The contract's patterns, for Python's re.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_personal_data(spark, none):
    t = ["mail a.b@x.example.com or c@d", "ip 1.2.3.4 and 256.1.1.1 and 0001.002.3.4.5", "card 4532 0151 1283 0366 or 4532-0151-1283-0367", "call +1 (212) 555-0100. or +1234", "é +49 30 1234567 日本 x@y.z", None, "", "+1-1@b.c"]
    ok = {"email": lambda v: True, "ip": lambda v: all(int(p) < 256 for p in v.split(".")), "card": lambda v: 16 <= sum(c.isdigit() for c in v) <= 19 and luhn(v), "phone": lambda v: 8 <= sum(c.isdigit() for c in v) <= 15}
    frame = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    for r in pii.find_personal_data(frame).collect():
        want = [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in re.finditer(PATTERNS[k], t[r.doc_id] or "") if ok[k](m.group())]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert pii.find_personal_data(none).count() == 0


def test_boosted_trees_learn():
    table = [(tuple(int(b) for b in f"{k:08b}"), 50, 45 if k & 1 or k & 64 else 2) for k in range(256)]
    trees = pii.boost(table)
    wrong = sum(n for x, n, p in table if (pii.score_of(trees, x) > 0) != (p > 25))
    assert wrong == 0 and math.isfinite(pii.threshold(trees, table, 0.85))


def test_urls(spark):
    urls = ["https://a.example.net/en/x", "http://EXAMPLE.net/en", "http://b.example.com/de/?q", "ftp://x.org/fr/#y", "http://org/fr/", "nothing", None, "", "http://xnet/", "https://example.com/de"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    none = (None, "allow")
    assert got == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("example.com/de/", "block"), 3: ("org/fr/", "allow"), 4: ("org/fr/", "allow"), 5: none, 6: none, 7: none, 8: none, 9: none}
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'block'").isEmpty()


def test_warc(spark):
    html = [None, "", "same", "same", "é" * 30_000, "a\r\n\r\nWARC/1.1\r\nb", "same"]
    pages = spark.createDataFrame([(k, f"http://x/{k}" if k else None, h) for k, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.read_pages(warc.write_archives(pages, new_folder(spark, "w"))).collect()}
    for k, h in enumerate(html):
        p = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].problem) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), None)
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if k == last else ("revisit", last))
    assert warc.read_pages(warc.write_archives(pages.limit(0), new_folder(spark, "w"))).count() == 0


def test_missing_segment_is_reported(spark):
    records = spark.createDataFrame([("<urn:page:1>", "response", "u", None, 1, None, None, "sha1:x", bytearray(b"ab"), "f"), ("s", "continuation", "u", "<urn:page:1>", 3, 6, None, None, bytearray(b"ef"), "f")], warc.RECORD)
    assert warc.reassembled(records).first().problem == "segments are missing or repeated"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda f: sorted(tuple("null" if x is None or x is pd.NA or x != x else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in f.astype(object).values.tolist())
    assert plain(got) == plain(want)


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()


def test_words_of_slices():
    texts = pa.array([f"Wörd{i} A b " * (i % 7) if i % 5 else None for i in range(300)])
    for typ in (pa.string(), pa.large_string()):
        for lower in (False, True):
            part = texts.cast(typ).slice(100, 120)
            ends, found = words_of(part, lower=lower)
            want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in part.to_pylist()]
            want = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in x] if lower else x for x in want]
            assert [found[s:e].to_pylist() for s, e in zip(ends[:-1], ends[1:], strict=True)] == want


def test_personal_data_in_very_long_texts(spark):
    long = {
        1: "7" * 300_000, 2: "a" * 300_000, 3: "x@" + ".".join(["ab"] * 30_000), 4: "12 a " * 40_000, 5: "1." * 100_000, 6: "+1" + "(" * 200_000, 7: "a@b.c_d@e.f%g@h.i@j.k 1.2.3.4.5.6.7.8 1.2.3",
        8: "-" * 200_000, 9: "4111 1111 1111 1111 " * 3_000, 10: "é日 me@x.org " * 5_000, 11: "1 " * 100_000,
    }
    frame = spark.createDataFrame(list(long.items()), "doc_id long, text string").repartition(4)
    for kind, pattern in PATTERNS.items():
        found = frame.select("doc_id", pii.matches(F.col("text"), pii.BASE[kind]).alias("m"))
        for r in found.collect():
            if kind == "email" and "@" not in long[r.doc_id]:
                want = []  # Python's re takes quadratic time here
            elif kind == "ip" and r.doc_id == 1:
                want = []
            else:
                want = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, long[r.doc_id])]
            assert [tuple(x) for x in r.m] == want, (kind, r.doc_id)
    assert pii.find_personal_data(frame).count() == len(long)


def test_pages_with_null_and_repeated_ids_and_long_payloads(spark, tmp_path):
    r = random.Random(3)
    big = ["".join(r.choices("abcdefgh ", k=60_000)) for _ in range(3)]
    rows = [(None, "u", big[0]), (None, None, "x"), (5, "u", big[1]), (5, "u", big[2]), (5, None, big[2]), (6, "v", None), (7, "v", ""), (8, "w", "y" * 3_000_000), (9, "w", big[0])]
    pages = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, again int").repartition(3)
    got = sorted(map(str, ((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.problem) for x in warc.read_pages(warc.write_archives(pages, f"file://{tmp_path}/warc")).collect())))
    last = {}
    for page_id, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page_id is None else page_id)
    origin = lambda k, h: None if last[h or ""] in (-1, k) else last[h or ""]
    want = sorted(str((k, len(h or ""), warc.payload_digest((h or "").encode()), "revisit" if origin(k, h) is not None else "response", origin(k, h), None)) for k, _, h in rows)
    assert got == want


def test_quality_wherever_an_empty_text_stands(spark):
    for texts in (["one two", ""], ["", "one two"], [None, "a b", " "], ["", None]):
        frame = spark.createDataFrame([(k, t, "en", "clash", True) for k, t in enumerate(texts)], "doc_id long, text string, lang string, log2_perplexity string, kept boolean").coalesce(1)
        got = {x.doc_id: (x.n_words, x.log2_perplexity is None) for x in quality.quality(frame).collect()}
        assert got == {k: (len((t or "").split()), not (t or "").split()) for k, t in enumerate(texts)}


def test_bands_follow_good_rows(spark):
    r = random.Random(8)
    texts = [" ".join(words(r.randint(60, 90), k)) for k in range(500)] + [" ".join(w + "###|||" for w in words(80, 900 + k)) for k in range(40)]
    frame = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(450)] + [(k, 0) for k in range(500, 520)], "doc_id long, quality int")
    kept = {x.doc_id for x in quality.quality(frame, labels).where("kept").collect()}
    assert not any(k in kept for k in range(500, 540)) and sum(k in kept for k in range(500)) >= 490


def test_all_good_rows_set_the_bands(spark):
    from quillspark.llm import quality

    labels = spark.range(120_000).selectExpr("id AS doc_id", "1 AS quality")
    assert quality.good_rows(labels).count() == 120_000
    # 1,000 rows between 0 and 1; the good ones reach to 1 quartile distance on either side, but for 5 of them.
    rows = [(k, "en", 60, 2 + k / 1000) for k in range(1000)] + [(1000 + k, "en", 60, 5.0) for k in range(5)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, log2_perplexity double")
    wide = quality.bands(scored, scored.select("doc_id"), 0.01, 4.0).first()
    none = quality.bands(scored, scored.where("1 = 0").select("doc_id"), 0.01, 4.0).first()
    assert abs(wide.lowest - 1.75) < 0.03 and abs(wide.highest - 3.25) < 0.03
    assert abs(none.lowest - 0.25) < 0.05 and abs(none.highest - 4.75) < 0.05


def test_rejected_rows_are_broadcast_by_count(spark):
    """By the size of their files, some 46,000 rejected rows were joined by a shuffle of all texts."""
    docs = spark.createDataFrame([(k, "word " * (k * 10), "en") for k in range(12)], "doc_id long, text string, lang string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = quality.keep_good(docs)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() < 12
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_retained_contexts_go_back_as_bits_in_passes(spark, monkeypatch):
    """Divergences went back to every slice as 64-bit numbers, and all slices lay in one shuffle beside their tables."""
    dice = random.Random(2)
    texts = [" ".join(dice.choice("abcdefgh") for _ in range(60)) for _ in range(40)]
    monkeypatch.setattr(suffix_tree, "SLICE", 300)
    seen, write = collections.defaultdict(list), suffix_tree.written

    def kept(df, name):
        out = write(df, name)
        seen[name].append(out.toArrow().to_pylist())
        return out

    monkeypatch.setattr(suffix_tree, "written", kept)
    assert suffix_tree.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 40
    parts = [{r["slice"] for r in x} for x in seen["asked-1"]]
    assert len(parts) == suffix_tree.PASSES and sum(map(len, parts)) == len(set().union(*parts)) == len(seen["slices"][0])
    a, b = (np.concatenate([suffix_tree.unpacked(r[c], np.int64) for x in seen["totals-1"] for r in x]) for c in "ab")
    assert (b > 0).any() and set(a[b > 0].tolist()) <= {0, 1}


def test_suffix_tree_finds_distinct_keys_by_sorting_numbers():
    """Keys were put in order by np.unique, and bytes side by side by copies of transposed arrays: over half of the CPU seconds."""
    dice = np.random.default_rng(3)
    far = dice.integers(0, 2**64, 5000, np.uint64)
    cases = [far[:0], far[:1], far, far[dice.integers(0, 5000, 20000)], far >> np.uint64(50), np.append(far, np.array([0, 2**64 - 1], np.uint64))]
    close = np.concatenate([far[:50] + np.uint64(k) for k in range(40)])  # they agree in their highest bits
    for keys in (*cases, close, np.append(close[dice.permutation(len(close))], far)):
        for got, want in zip(suffix_tree.distinct(keys), np.unique(keys, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()
    for x in (far, far[:0], far.view(np.int64)[::3], (far % np.uint64(2)).astype(np.uint8), far.astype(np.int32)):
        assert suffix_tree.unpacked(suffix_tree.packed(x), x.dtype).tolist() == x.tolist()


def test_suffix_tree_learns_by_keys_alone(monkeypatch):
    """A slice worked out all divergences anew to find the order of its keys, each time that it was read."""
    words = np.arange(12, dtype=np.int32) % 5
    ends = np.array([0, 12])
    row = {"doc_ids": [3], "ends": suffix_tree.packed(ends), "hashes": suffix_tree.packed(np.ones(5, np.uint64)), "which": suffix_tree.packed(words)}
    part = suffix_tree.Slice(row, 2)
    sent = [suffix_tree.ask(part, 0, 0, 1)]
    monkeypatch.setattr(suffix_tree.Slice, "asked", None)
    total = suffix_tree.summed(0, 1.0)(sent[0]).to_pylist()[0]
    part.learn(0, *(suffix_tree.unpacked(total[c], k) for c, k in (("a", np.int64), ("b", np.int64))), suffix_tree.unpacked(total["owned"], np.uint8).astype(bool), 12)
    assert part.n[0].tolist() == [3, 3, 2, 2, 2, 3, 3, 2, 2, 2, 3, 3]


def test_join_tasks_drop_the_encoder_of_an_earlier_packing(spark, monkeypatch):
    """Workers held the pieces of an earlier packing all through near_duplicates."""
    docs, made = spark.createDataFrame([(0, "a b c d e f")], "doc_id long, text string"), []
    call = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: made.append(f) or call(self, f, schema))
    sets, sent = jaccard_join.sets_of(docs), jaccard_join.shared_signatures(docs, 8)
    assert len(made) == 2 and sets.count() == 1 and sent.columns[0] == "sig"
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1], "text": ["a b c d e f", "a b"]})
    for f in made:
        assert shared_encoder(tokenizer_path()) is not None
        assert sum(r.num_rows for r in f(iter([batch])))
        assert shared_encoder.cache_info().currsize == 0


def test_no_two_code_points_fall_together():
    """Beyond ASCII, code points that differ by a multiple of ten were one symbol; so were capitals and small letters, all digits, and most marks."""
    points = np.array([p for p in range(0x110000) if p not in (9, 10, 11, 12, 13, 32) and not 0xD800 <= p < 0xE000], np.uint32)
    found, ends = quality.symbols(points, np.arange(len(points) + 1), quality.symbol_table())
    assert found.min() > 0 and found.max() < quality.SYMBOLS and set(np.diff(ends)) == {1, 2}
    first, second = found[ends[:-1]].astype(np.int64), np.where(np.diff(ends) == 2, found[ends[1:] - 1], 0)
    assert len(np.unique(first * quality.SYMBOLS + second)) == len(points)
    assert not set(first[np.diff(ends) == 1]) & set(first[np.diff(ends) == 2])


def kneser_ney(taught, size):
    """The probability of a list of symbols' last one after the others, learned from lists of symbols: by loops over dictionaries."""
    counts = {4: collections.Counter(tuple(t[k : k + 4]) for t in taught for k in range(len(t) - 3))}
    for order in (3, 2, 1):
        counts[order] = collections.Counter(g[1:] for g in counts[order + 1])
    off, after = {}, {}
    for order, c in counts.items():
        n = [sum(x == k for x in c.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if all(n[1:]) else 0
        off[order] = [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)] if all(n[1:]) else [0, 0.5, 0.75, 0.75]
        after[order] = collections.defaultdict(list)
        for g, x in c.items():
            after[order][g[:-1]].append(x)

    def p(gram):
        if not gram:
            return 1 / size
        order, there = len(gram), after[len(gram)].get(gram[:-1])
        if not there:
            return p(gram[1:])
        n = counts[order].get(gram, 0)
        return (n - off[order][min(n, 3)] + sum(off[order][min(x, 3)] for x in there) * p(gram[1:])) / sum(there)

    return p


def test_perplexity_by_loops_in_any_language(spark, monkeypatch):
    """Languages but four shared one model, and it counted what fails the base rule with the rest."""
    monkeypatch.setattr(quality, "FILE", 700)
    dice = random.Random(4)
    letters = {"ru": "абвгдежзиклмнопр", "ja": "あいうえ日本語学\U0001f600", "en": "abcdefgABC#12", None: "xyzé", "": "xyzw"}
    word = lambda lang: "".join(dice.choice(letters[lang]) for _ in range(dice.randint(1, 5)))
    rows = [(k, " \n".join(word(lang) for _ in range(dice.choice((8, 55, 70)))), lang) for k, lang in enumerate(list(letters) * 16)]
    labels = spark.createDataFrame([(k, int(k % 4 < 2)) for k, _, lang in rows if lang == "ru"], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()}
    of = lambda c: (" ",) if c.isspace() else (c,) if ord(c) < quality.SINGLE else ((ord(c) // (quality.SYMBOLS - 1),), ord(c) % (quality.SYMBOLS - 1))
    stream = {k: [" "] * 3 + [x for c in re.sub(r"\s+", " ", t) for x in of(c)] + [" "] for k, t, _ in rows}
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    for lang in letters:
        for h in (0, 1):
            other = [k for k, _, x in rows if x == lang and half[k] != h and not got[k].base_failed]
            other = [k for k in other if lang != "ru" or k % 4 < 2]
            assert other
            p = kneser_ney([stream[k] for k in other], quality.SYMBOLS)
            for k in [k for k, _, x in rows if x == lang and half[k] == h][:3]:
                grams = [tuple(stream[k][j : j + 4]) for j in range(len(stream[k]) - 3)]
                assert abs(got[k].log2_perplexity + sum(math.log2(p(g)) for g in grams) / len(grams)) < 1e-4, (lang, k)


def test_counting_with_more_languages_than_slots(monkeypatch):
    langs = [f"x{k % 9}" if k % 9 else None for k in range(40)]
    texts = [" ".join(words(10, k)) for k in range(40)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 2]), "lang": pa.array(langs[k : k + 2], pa.string())}) for k in range(0, 40, 2)]
    totals = []
    for slots, held in ((2000, 10**6), (6, 100)):
        monkeypatch.setattr(quality, "SLOTS", slots)
        monkeypatch.setattr(quality, "HELD", held)
        sums = collections.Counter()
        for b in quality.ngram_counts(iter(batches), lambda batch: np.array([len(x) % 3 for x in batch["text"].to_pylist()])):
            assert max(b["code"].to_pylist()) < 2**63 - 1 and max(b["code"].to_pylist()) // quality.SYMBOLS**quality.ORDER <= slots
            for model, code, *n in zip(*(b[c].to_pylist() for c in ("model", "code", "n", "passing", "good")), strict=True):
                for k, x in enumerate(n):
                    sums[model, code % quality.SYMBOLS**quality.ORDER, k] += x
        totals.append(+sums)
    assert totals[0] == totals[1] and len({m for m, _, _ in totals[0]}) == 9


def test_letters_that_were_one_symbol_are_told_apart(spark):
    """Thirty texts in letters ten places on had the same symbols as the good ones, and were kept."""
    dice = random.Random(6)
    good = [" ".join("".join(dice.choice("абвгде") for _ in range(4)) for _ in range(70)) for _ in range(450)]
    moved = [" ".join("".join(chr(ord(dice.choice("абвгде")) + 10) for _ in range(4)) for _ in range(70)) for _ in range(30)]
    docs = spark.createDataFrame([(k, t, "ru") for k, t in enumerate(good + moved)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(440)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.quality(docs, labels).where("kept").collect()}
    assert not kept & set(range(450, 480)) and len(kept) >= 435
