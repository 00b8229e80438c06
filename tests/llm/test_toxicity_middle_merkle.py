"""Operators 11 to 13: held-out accuracy, brute force and exact round trips, on tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import fill_middle, merkle, registry, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tree string, form string, output string, score double, toxic int"


def rows(texts, first=0):
    return [(k + first if k != 3 else None, t, ("en", None, "de", "Ü", "z")[k % 5], f"s{k % 2}" if k % 4 else None, len(t or "") if k % 6 else None, "x", "x", "x", "x", 0.5, 7) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    some = ["".join(r.choice("aQ cé日😀\n") for _ in range(r.randint(1, 80))) for _ in range(150)]
    return [None, "", "a", "null id", "<", "x<P>y", "<S>", "ends with <", "P>S>M>", "Ünï 😀 çödé", "same", "same", *some, "ABC Long " * 40_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    made = rows(texts)
    return spark.createDataFrame([*made, made[10], made[10], made[20]], SCHEMA).repartition(5)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def middle_by_hand(doc_id, text):
    t = text or ""
    key = digest(f"1:{'' if doc_id is None else doc_id}")
    h = [int(key[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_middle_equals_cutting_by_hand(docs):
    made = fill_middle.transform(docs)
    back = fill_middle.restore(made).collect()
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    source = docs.select("doc_id", "text").collect()
    assert got == sorted((str(r.doc_id), *middle_by_hand(r.doc_id, r.text)) for r in source)
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in source)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_blocks_do_not_change_what_is_moved(texts, block, monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    some = [t for t in texts if len(t or "") < 100]
    data, ends = fill_middle.text_bytes(pa.array(some))
    r = random.Random(block)
    cuts = np.array([sorted((r.randint(0, len(t or "")), r.randint(0, len(t or "")))) for t in some]).T
    forms = np.array([0 if any(m in (t or "") for m in ("<P>", "<S>", "<M>")) else r.randint(0, 2) for t in some])
    out, out_ends = fill_middle.scatter(data, ends, fill_middle.cut_places(data, ends, cuts), forms)
    want = [
        t if not f else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" if f == 1 else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
        for t, a, b, f in zip([t or "" for t in some], *cuts.tolist(), forms.tolist(), strict=True)
    ]
    assert fill_middle.strings(out, out_ends).to_pylist() == want
    assert fill_middle.strings(*fill_middle.gather(out, out_ends, forms)).to_pylist() == [t or "" for t in some]


def test_outputs_without_their_marks_are_refused():
    data, ends = fill_middle.text_bytes(pa.array(["<P>a<S>b<M>c", "<P>a<S>b"]))
    with pytest.raises(ValueError, match="each mark"):
        fill_middle.gather(data, ends, np.array([1, 1]))


def merkle_by_hand(records):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def climb(nodes):
        """The root, and for each node the siblings and places on its way."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, way in enumerate(ways):
                run = nodes[at[k] // 8 * 8 : at[k] // 8 * 8 + 8]
                way.append((at[k] % 8, run[: at[k] % 8] + run[at[k] % 8 + 1 :]))
                at[k] //= 8
            nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], ways

    trees = {}
    for r in records:
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for x in langs:
        trees[x].sort(key=lambda y: y[:3])
        built[x] = climb([y[2] for y in trees[x]])
    root, top = climb([built[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for (_, _, own, r), way in zip(trees[x], built[x][1], strict=True):
            tampered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            now = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)) if tampered else own
            whole = way + top[k]
            for place, siblings in whole:
                now = digest("".join([*siblings[:place], now, *siblings[place:]]))
            out.append((r.doc_id, own, built[x][0], root, digest("".join(s for _, run in whole for s in run)), now, now == root))
    return out


@pytest.mark.parametrize("broadcast_nodes", [3, 50_000])
def test_manifest_equals_a_tree_by_hand(docs, broadcast_nodes):
    got = merkle.manifest(docs, broadcast_nodes).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = merkle_by_hand(docs.collect())
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("count", [1, 2, 8, 9])
def test_small_manifests(spark, count):
    d = spark.createDataFrame([(k, "Ab", "en", "s", 2) for k in range(count)], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(d).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, merkle_by_hand(d.collect())))


def test_empty_tables(spark, docs):
    none = docs.where("1 = 0")
    assert merkle.manifest(none).count() == 0
    assert fill_middle.restore(fill_middle.transform(none)).count() == 0
    model = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_texts(none, model).count() == 0
    assert all(0 < r.score < 0.5 for r in toxicity.score_texts(docs, model).collect())


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_merkle_manifest"])
def test_same_as_sql_on_edges(spark, docs, name, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    same = lambda d: sorted(map(str, d[sorted(d)].astype(object).where(d[sorted(d)].notna(), None).to_dict("records")))
    for frame in (got, want):
        for c in ("prefix_chars", "middle_chars", "doc_id"):
            if c in frame:
                frame[c] = frame[c].astype("Int64")
    assert same(got) == same(want)


def read(text, model=None):
    return (model or toxicity.Model({})).read(text)[0]


def test_clauses_are_weighed_by_what_stands_around_an_insult():
    plain, direct = read("An idiot is here."), read("You are an idiot.")
    assert 0 < read("He said you are an idiot.") < direct
    assert 0 < read("You are not an idiot.") < direct
    assert 0 < plain < direct < read("You idiot. You moron!")
    assert read('"You idiot" was heard.') < direct
    assert read("She said nothing, but you idiot") == read("you idiot")
    assert read("I will kill you.") > 0 == read("I will kill time.") == read("Nothing here.") == read("")


def test_composition_equals_its_parts():
    r = random.Random(3)
    for _ in range(50):
        word = [r.randrange(toxicity.SYMBOLS) for _ in range(30)]
        state, total = 0, 0.0
        parts, apart = [s for s, _ in toxicity.MACHINES], 0.0
        for symbol in word:
            total += toxicity.WEIGHT[state][symbol]
            state = toxicity.NEXT[state][symbol]
            moved = [step(s, symbol) for s, (_, step) in zip(parts, toxicity.MACHINES, strict=True)]
            parts, apart = [s for s, _ in moved], apart + sum(w for _, w in moved)
        assert total == pytest.approx(apart)


def test_lexicon_is_learned_and_holds_on_held_out_texts(spark):
    r = random.Random(5)
    common = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    made, labels = [], []
    for k in range(900):
        words = [r.choice(common) for _ in range(60)]
        toxic = k % 7 == 0
        for _ in range(3 if toxic else 0):
            words[r.randrange(60)] = "gromf" + r.choice(["a", "en", "ix", "ully"])
        made.append((k, ". ".join(" ".join(words[i : i + 9]) for i in range(0, 60, 9)), "g", 1.0))
        labels.append((k, int(toxic)))
    made += [(5000, None, "g", 1.0), (5001, "", "g", 1.0), (None, "gromfix gromfa gromfen", "g", 1.0), (5002, "gromfix " * 200_000, "g", 1.0)]
    d = spark.createDataFrame(made, "doc_id long, text string, evidence string, score double")
    y = spark.createDataFrame([*labels, labels[0], (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(d.unionByName(d.limit(5)), y)
    assert any(p.startswith("grom") for p in model.counts)
    got = {x.doc_id: x.score for x in toxicity.score_texts(d, model).collect()}
    assert len(got) == len(made)
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 100
    assert all((got[k] >= 0.5) == (k % 7 == 0) for k in held)
    assert got[5000] == got[5001] < 0.5 < min(got[None], got[5002])


def test_labels_of_held_out_documents_teach_nothing(spark):
    d = spark.createDataFrame([(k, "rare insultish words here") for k in range(200)], "doc_id long, text string")
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0]
    model = toxicity.train(d, spark.createDataFrame([(k, 1) for k in held], "doc_id long, toxic int"))
    assert (model.toxic, model.clean, model.counts) == (0, 0, {})


def test_toxicity_of_the_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["op11_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    assert sum(r.predicted == 1 and r.toxic == 0 for r in got) <= 0.02 * len(got)
