"""Parsing, packing, box and allocation operators against plain loops, with nulls, ties, repeated rows and empty tables."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from quillspark.operators import allocation, boxes, markup, packers, salvage, shared_options, wrapped
from quillspark.plans import all_queries

SF = "/root/testdata/sf0.001"


# JSON salvage


def valid(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def largest_by_trying(text):
    """The longest part between brackets that parses; the first of equal ones."""
    parts = [(a, b) for a, x in enumerate(text) if x in "{[" for b, y in enumerate(text) if b > a and y in "}]" and valid(text[a : b + 1])]
    return text[slice(*max(((a, b + 1) for a, b in parts), key=lambda s: (s[1] - s[0], -s[0])))] if parts else None


@pytest.mark.parametrize(
    ("text", "state", "found"),
    [
        (None, "empty_response", None), ("  \n", "empty_response", None), ("```json\n```", "empty_response", None),
        ('{"a": 1}', "raw", '{"a": 1}'), (" 3 ", "raw", "3"), ('```json\n{"a": 1}\n```', "cleaned", '{"a": 1}'), ('{"a": [1, 2,],}', "cleaned", '{"a": [1, 2]}'),
        ("{“a”: “b”}", "cleaned", '{"a": "b"}'), ('Here: {"a": "}"} done', "balanced", '{"a": "}"}'), ('x {"a": "\\"}"} y', "balanced", '{"a": "\\"}"}'),
        ('say "{ or {"a": 1}', "largest", '{"a": 1}'), ('{"x": } [1, 2, 3] {"b": 2}', "largest", "[1, 2, 3]"), ('[{"a": }, {"b": [1, {"c": 2}]}]', "largest", '{"b": [1, {"c": 2}]}'),
        ('{"a": "never', "truncation_unterminated_string", None), ('{"a": [x', "truncation_missing_closing_bracket", None),
        ('"id": 1, "id": 1', "truncation_repeated_object_prefix", None), ("nothing here", "invalid_json", None), ("[" * 5000, "truncation_missing_closing_bracket", None),
    ],
)
def test_salvage(text, state, found):
    assert salvage.salvage(text) == (state, found)


def test_salvage_finds_what_trying_all_parts_finds():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(['{"a":1}', "[", "]", "{", "}", '"', "\\", "1", ",", ":", '"b"', " ", "[2]"]) for _ in range(r.randint(1, 14)))
        state, found = salvage.salvage(text)
        clean = salvage.cleaned(text)
        if state == "largest":
            assert len(found) == len(largest_by_trying(clean))
        elif state in salvage.FAILURES:
            assert found is None and largest_by_trying(clean) is None
        else:
            assert valid(found)


def test_salvage_of_deep_and_long_texts_is_linear():
    assert salvage.salvage("{x[" * 100_000 + "}]" * 100_000)[0] in salvage.FAILURES
    assert salvage.salvage("[{x}" * 50_000 + "]" * 50_000)[0] in salvage.FAILURES


def test_only_failures_leave_the_jvm(spark):
    df = spark.createDataFrame([(1, '{"a": 1}', "x"), (1, '{"a": 1}', "x"), (None, '{"a": 2,}', "y"), (3, None, "z")], "k long, text string, state string")
    got = sorted((str(r.id), r.state, r.json) for r in salvage.salvage_json(df, "k", "text").collect())
    assert got == [("1", "raw", '{"a": 1}'), ("1", "raw", '{"a": 1}'), ("3", "empty_response", None), ("None", "cleaned", '{"a": 2}')]
    assert salvage.salvage_json(df.where("1 = 0"), "k", "text").count() == 0


# Markup


class Rules(HTMLParser):
    """The same rules on the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.open, self.found = [], []
        self.feed(html)
        self.found += [(markup.UNCLOSED, t) for t in self.open]

    def handle_starttag(self, tag, attrs):
        if tag not in markup.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in markup.VOID:
            return
        if self.open and self.open[-1] == tag:
            self.open.pop()
        else:
            self.found.append((markup.UNEXPECTED, tag))


def audited(html):
    return [x[1:3] for x in markup.audit(html)]


def test_markup_of_all_pages_equals_the_library(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert [audited(p.html) for p in pages] == [Rules(p.html).found for p in pages]
    assert any(audited(p.html) for p in pages)


def test_markup_of_random_tags_equals_the_library():
    r = random.Random(2)
    parts = ["<p>", "</p>", "<b>", "</B>", "<br>", "<br/>", "</br>", "<i/>", '<a href="x>y">', "<a title='</p>'>", "</a>", "<!-- <p> -->", "<!DOCTYPE html>", "<?php x?>", "<script>", "</script>", "if (a<b)", "<style>", "</style >", "text", "1 < 2", "&amp;", "<img src=x>", "<DIV\nclass=a>", "</div>"]
    for _ in range(2000):
        html = "".join(r.choice(parts) for _ in range(r.randint(0, 12))) + " "
        assert audited(html) == Rules(html).found, html


def test_markup_rows(spark):
    pages = spark.createDataFrame([(1, "<p><b>x</p>", "t"), (1, "<p><b>x</p>", "t"), (2, None, "t"), (3, "", "t"), (None, "</i>", "t"), (5, "<p>" * 50_000, "t")], "page_id long, html string, tag string")
    found = markup.markup_findings(pages)
    rows = sorted(map(str, map(tuple, found.where("page_id < 5 OR page_id IS NULL").collect())))
    one = ["(1, 1, 'unclosed tag', 'p', None)", "(1, 2, 'unclosed tag', 'b', 'p')", "(1, 3, 'unexpected closing tag', 'p', 'b')"]
    assert rows == sorted([*one, *one, "(None, 1, 'unexpected closing tag', 'i', None)"])
    summary = {(r.finding, r.tag): (r.pages, r.rows) for r in markup.markup_summary(found).collect()}
    assert summary["unclosed tag", "p"] == (2, 50_002)
    assert markup.markup_findings(pages.where("1 = 0")).count() == 0


# Wrapped lines


def join_by_rescanning(text):
    import re

    lines = [x for x in (re.sub(r"[ \t\n\r\f\v]+", " ", y).strip(" -•\t") for y in re.split(r"\r\n|\n|\r", text)) if x]
    out = []
    for line in lines:
        if out:
            low, n, m = out[-1].lower(), len(re.findall(r"\w+", out[-1])), len(re.findall(r"\w+", line))
            if low.strip(":") in wrapped.ALONE or (n <= 2 and re.match(rf"({'|'.join(wrapped.AT_START)})\b", line.lower())) or re.search(rf"\b({'|'.join([*wrapped.AT_END, *wrapped.LAST_WORDS])})$", low) or (n <= 5 and m <= 2 and not line.endswith(":")) or low in wrapped.WHOLE:
                out[-1] += " " + line
                continue
        out.append(line)
    return out


def test_lines_are_joined():
    assert wrapped.join_lines("Empiric\ntherapy starts at once today\n- Renal artery\nstenosis is a cause of it\nGoals:\nwith care") == ["Empiric therapy starts at once today", "Renal artery stenosis is a cause of it", "Goals: with care"]
    assert wrapped.join_lines("one two three four five six\nTwo words\nLabel here:\nA long line of seven words it is") == ["one two three four five six", "Two words", "Label here:", "A long line of seven words it is"]
    assert wrapped.join_lines("") == [] == wrapped.join_lines(" \n -\n")
    r = random.Random(3)
    words = ["urine", "Blood:", "with", "renal", "artery", "x", "started,", "consider", "Ünï", "iv", "a-b", "or", "end:"]
    for _ in range(2000):
        text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 9)))
        assert wrapped.join_lines(text) == join_by_rescanning(text), text
    assert len(wrapped.join_lines("urine\n" * 200_000)) == 1


def test_unwrap_rows(spark):
    docs = spark.createDataFrame([(1, "oral\nx y z", 9), (1, "oral\nx y z", 9), (2, None, 9), (3, "", 9), (None, "a", 9)], "doc_id long, text string, k long")
    assert sorted(str(tuple(r)) for r in wrapped.unwrap(docs).collect()) == ["(1, 1, 'oral x y z')", "(1, 1, 'oral x y z')", "(None, 1, 'a')"]
    assert wrapped.unwrap(docs.where("1 = 0")).count() == 0


# Shared options

BANK = [f"{x}) option {x.lower()}" for x in "ABCDE"]
BINDS = "The response options for the next 2 items are the same."
SHARED = "For each case, select one."
CASES = {
    "standalone": ({1: ["1. A first stem of one line.", *BANK]}, (1, False, 5, None, None)),
    "wrapped stem": ({2: ["2. A long stem that", "goes on here.", *BANK]}, (1, False, 5, None, None)),
    "with a table": ({3: ["3. Findings are shown.", "Na+ 121 Cl- 86", *BANK]}, (1, False, 5, None, None)),
    "repeated bank": ({33: [BINDS, SHARED, *BANK, "33. First case."], 34: [SHARED, *BANK, "34. Second case."]}, (2, True, 5, 33, 34)),
    "inherited bank": ({10: [BINDS, SHARED, *BANK, "10. First case."], 11: ["11. Second case."]}, (2, True, 5, 10, 11)),
    "over pages": ({20: [BINDS, SHARED, *BANK[:4], "20. First case."], 21: ["21. Second case."]}, (2, True, 4, 20, 21)),
    "neighbours": ({40: ["40. One.", *BANK], 41: ["41. Other.", *[x + "!" for x in BANK]]}, (2, False, 5, None, None)),
    "answers": ({50: [BINDS, SHARED, *BANK, "50. First."], 51: ["51. Second."]}, (2, True, 5, 50, 51)),
}


def test_shared_options_of_all_cases(spark):
    rows = [(name, n, lines) for name, (found, _) in CASES.items() for n, lines in found.items()]
    answers = spark.createDataFrame([("answers", 50, "E"), ("answers", 51, "B"), ("standalone", 1, "Z")], "set_id string, number long, correct string")
    got = shared_options.grouped(spark.createDataFrame(rows, "set_id string, number long, lines array<string>").repartition(4), answers).collect()
    for name, (found, (count, is_group, choices, first, last)) in CASES.items():
        mine = [r for r in got if r.set_id == name]
        assert len(mine) == count == len(found)
        assert all((r.grouped, len(r.options), r.range_start, r.range_end) == (is_group, choices, first, last) for r in mine), name
        assert all(r.shared == (SHARED if is_group else None) for r in mine)
    by = {(r.set_id, r.number): r for r in got}
    assert by["wrapped stem", 2].stem == "A long stem that goes on here." and by["inherited bank", 11].source == "group"
    assert [by[k].key_valid for k in (("answers", 50), ("answers", 51), ("standalone", 1))] == [True, True, False]


def test_shared_options_on_the_edges(spark):
    rows = [
        ("a", 1, ["Choices for the next 900000000 items are the same.", *BANK, "1. x"]), ("a", 2, ["2. y"]), ("a", 3, [BINDS, *BANK[:2], "3. z"]), ("a", 4, ["4. w"]), ("a", 5, ["5. v"]),
        ("b", 1, [BINDS, "1. no bank"]), ("b", 2, ["2. x"]), ("c", 1, None), ("c", None, [BINDS, *BANK, "1. x"]), (None, 1, [BINDS, *BANK, "1. x"]), ("d", 1, [BINDS, *BANK, "1. x"]), ("d", 2, ["2. y"]), ("d", 2, ["2. y"]), ("d", 2, [BANK[0], "2. own"]),
    ]
    df = spark.createDataFrame(rows, "set_id string, number long, lines array<string>")
    got = sorted((str(r.set_id), str(r.number), r.stem, len(r.options), r.source, r.grouped, r.range_end) for r in shared_options.grouped(df).collect())
    assert got == [
        ("None", "1", "x", 5, "own", False, None), ("a", "1", "x", 5, "own", True, 2), ("a", "2", "y", 5, "group", True, 2), ("a", "3", "z", 2, "own", True, 4), ("a", "4", "w", 2, "group", True, 4), ("a", "5", "v", 0, "none", False, None),
        ("b", "1", "no bank", 0, "none", False, None), ("b", "2", "x", 0, "none", False, None), ("c", "1", "", 0, "none", False, None), ("c", "None", "x", 5, "own", False, None),
        ("d", "1", "x", 5, "own", True, 2), ("d", "2", "own", 1, "own", False, None), ("d", "2", "y", 5, "group", True, 2), ("d", "2", "y", 5, "group", True, 2),
    ]
    assert shared_options.grouped(df.where("1 = 0")).count() == 0


# Packers


def pack_by_hand(pages, cap):
    """Chunks of one document's (page, text, figures), as a loop over texts."""
    import re

    chunks, buf, first, last, figs = [], "", None, None, []

    def flush():
        nonlocal buf, figs
        if buf:
            chunks.append((first, last, buf, figs))
        buf, figs = "", []

    for page, text, figures in pages:
        text = text.strip()
        parts = [text] if len(text) <= cap else [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]
        if len(text) > cap:
            flush()
        for k, part in enumerate(parts if text else []):
            if buf and len(buf) + 2 + len(part) > cap:
                flush()
            first = page if not buf else first
            buf, last = f"{buf}\n\n{part}" if buf else part, page
            figs = figs + (figures if not k else [])
    flush()
    return chunks


@pytest.mark.parametrize("cap", [5, 20, 60])
def test_page_packer(spark, cap):
    r = random.Random(cap)
    made = {d: [(p, r.choice(["", "\n\n"]).join(r.choice(["ab", " c ", "ü\n", "\n\n", "longer word "]) for _ in range(r.randint(0, 6))), [f"f{d}.{p}"] * r.randint(0, 2)) for p in range(1, 12)] for d in range(12)}
    rows = [(d, p, t, f, 1) for d, pages in made.items() for p, t, f in pages]
    df = spark.createDataFrame([*rows, (99, 1, None, ["x"], 1), (98, 1, " ", ["x"], 1), (97, 5, "alone", None, 1)], "doc_id long, page long, text string, figures array<string>, chunk int").repartition(5)
    got = {}
    for x in packers.pack_pages(df, cap).orderBy("doc_id", "chunk").collect():
        got.setdefault(x.doc_id, []).append((x.page_start, x.page_end, x.text, x.figures))
    want = {d: c for d, pages in made.items() if (c := pack_by_hand(pages, cap))}
    assert got == {**want, 97: [(5, 5, "alone", [])]}
    assert packers.pack_pages(df.where("1 = 0"), cap).count() == 0


def test_cost_batches_over_many_ranges(spark):
    r = random.Random(8)
    rows = [(s, k, float(r.choice([900, 2000, 3000, 7000]))) for s, n in (("hot", 700), ("b", 50), (None, 30), ("one", 1)) for k in range(n)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        df = spark.createDataFrame([(*x, 5) for x in rows], "source string, position long, cost double, batch int").repartition(7)
        got = {(x.source, x.position): x.batch for x in packers.cost_batches(df).collect()}
        assert packers.cost_batches(df.where("1 = 0")).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for s in ("hot", "b", None, "one"):
        n = total = batch = 0
        for _, k, c in sorted((x for x in rows if x[0] == s), key=lambda x: x[1]):
            if not n or n >= 3 or total + c > 6500:
                n = total = 0
                batch += 1
            n, total = n + 1, total + c
            want[s, k] = batch
    assert got == want


# Boxes


def random_boxes(seed, pages=6, most=40):
    r = random.Random(seed)
    rows = []
    for p in range(pages):
        for b in range(r.randint(0, most)):
            x, y = r.randint(0, 700), r.randint(0, 900)
            rows.append((p, b, x, y, x + r.randint(1, 250), y + r.randint(1, 250), r.randint(0, 5) / 5, r.randint(0, 5) / 5, r.randint(0, 5) / 5))
        rows += [(p, 100 + k, *row[2:]) for k, row in enumerate(rows[-3:]) if row[0] == p]
    return rows


BOXES = "page long, box long, x0 long, y0 long, x1 long, y1 long, score double, visual double, textual double"


def overlap(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def size(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def suppress_by_hand(rows):
    out = {}
    quality = lambda b: round(b[6] + 0.28 * b[7] - 0.2 * b[8] + (0.035 if size(b) < 900_000 else 0), 9)
    for page in {r[0] for r in rows}:
        kept = []
        for c in sorted((r for r in rows if r[0] == page), key=lambda b: (-quality(b), -b[7], b[8], size(b), b[1])):
            by = None
            for e in kept:
                both = overlap(c, e)
                if both and (both / (size(c) + size(e) - both) >= 0.58 or (both / size(c) >= 0.9 and size(c) <= size(e) and quality(c) <= quality(e) + 0.08) or (both / size(e) >= 0.94 and size(c) > size(e) * 1.18 and quality(c) <= quality(e) + 0.12)):
                    by = e[1]
                    break
            out[page, c[1]] = by
            if by is None:
                kept.append(c)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_suppression_equals_the_loop(spark, parts):
    rows = random_boxes(parts)
    df = spark.createDataFrame(rows, BOXES).repartition(parts)
    got = {(r.page, r.box): r.suppressed_by for r in boxes.suppress(df).collect()}
    assert got == suppress_by_hand(rows)
    assert 0 < sum(v is None for v in got.values()) < len(got)


def test_no_table_of_boxes_is_broadcast(spark, monkeypatch):
    """Written boxes are small as files and large in memory: gathered for broadcasts, they filled the driver at 1 GB."""
    plans, write = [], boxes.written
    monkeypatch.setattr(boxes, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    df = spark.createDataFrame([(p, k, k * 30, 0, k * 30 + 40, 50, 0.5, 0.5, 0.5) for p in range(3) for k in range(9)], "page long, box long, x0 long, y0 long, x1 long, y1 long, score double, visual double, textual double")
    assert boxes.merge(df, 2, 400, 400).count() == 3
    plans.append(boxes.suppress(df)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_boxes_on_the_edges(spark):
    df = spark.createDataFrame([(None, 1, 0, 0, 9, 9, 1.0, 1.0, 1.0), (None, 2, 0, 0, 9, 9, 1.0, 1.0, 1.0), (1, 1, None, 0, 9, 9, 1.0, 1.0, 1.0)], BOXES)
    assert [r.kept for r in boxes.suppress(df).collect()] == [True] * 3
    assert boxes.suppress(df.where("1 = 0")).count() == 0
    assert boxes.merge(df, 5, 100, 100).count() == 0


def merge_by_hand(rows, margin, width, height):
    out = []
    for page in {r[0] for r in rows}:
        left = [[*r[2:6], 1] for r in rows if r[0] == page]
        changed = True
        while changed:
            changed = False
            for i in range(len(left)):
                for j in range(len(left)):
                    a, b = left[i], left[j]
                    if i != j and b[0] < min(width, a[2] + margin) and max(0, a[0] - margin) < b[2] and b[1] < min(height, a[3] + margin) and max(0, a[1] - margin) < b[3]:
                        left[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]
                        del left[j]
                        changed = True
                        break
                if changed:
                    break
        out += [(page, *x) for x in left]
    return sorted(out)


@pytest.mark.parametrize("margin", [0, 15])
def test_merging_equals_the_loop(spark, margin):
    rows = [r for r in random_boxes(margin + 3, 5, 14) if r[4] < 900 and r[5] < 1100]
    df = spark.createDataFrame(rows, BOXES).repartition(5)
    got = sorted(tuple(r) for r in boxes.merge(df, margin, 950, 1150).collect())
    assert got == merge_by_hand(rows, margin, 950, 1150)


def test_a_chain_of_boxes_becomes_one(spark):
    rows = [(1, k, 20 * k, 20 * k, 20 * k + 21, 20 * k + 21, 0.0, 0.0, 0.0) for k in range(40)]
    assert [tuple(r) for r in boxes.merge(spark.createDataFrame(rows, BOXES), 2, 1000, 1000).collect()] == [(1, 0, 0, 801, 801, 40)]


# Allocation


def allocate_by_hand(rows):
    out = {}
    for source in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == source), key=lambda r: r[1])
        counts = {}
        for r in mine:
            for k in set(r[6]):
                counts[k] = counts.get(k, 0) + 1
        taken = set()
        for _, pos, potential, richness, categories, types, keys in mine:
            keys, red = set(keys), 0.0
            if keys:
                red = max(sum(counts[k] > 1 for k in keys) / len(keys), len(keys & taken) / len(keys))
            n = 0
            if not set(types) & {"ADMINISTRATIVE", "TRANSITION_SLIDE"}:
                if potential >= 85 and richness >= 12 and categories >= 2 and red < 0.35 and set(types) & {"HIGH_YIELD_CLINICAL", "MECHANISM"}:
                    n = 2
                elif (potential >= 50 and richness >= 3 and red < 0.8) or (set(types) & {"IMAGE_HEAVY", "TABLE_HEAVY"} and potential >= 40 and red < 0.85):
                    n = 1
            if n:
                taken |= keys
            out[source, pos] = (n, round(red, 3))
    return out


SLIDE = "source string, position long, potential long, richness long, categories long, types array<string>, keys array<string>"


def test_allocation_equals_the_loop(spark):
    r = random.Random(6)
    kinds = ["ADMINISTRATIVE", "HIGH_YIELD_CLINICAL", "MECHANISM", "IMAGE_HEAVY", "TABLE_HEAVY", "OTHER"]
    rows = [(s, p, r.randint(30, 100), r.randint(0, 20), r.randint(0, 4), r.sample(kinds, r.choice([1, 1, 2])), [f"k{r.randint(0, 60 if s == 'a' else 900)}" for _ in range(r.randint(0, 6))]) for s in ("a", "b", "c") for p in range(150)]
    df = spark.createDataFrame(rows, SLIDE).repartition(6)
    got = {(x.source, x.position): (x["count"], x.redundancy) for x in allocation.allocate(df).collect()}
    assert got == allocate_by_hand(rows)
    assert {n for n, _ in got.values()} == {0, 1, 2}


def test_allocation_on_the_edges(spark):
    df = spark.createDataFrame([(None, 1, 90, 15, 3, ["MECHANISM"], None), ("a", 1, None, None, None, None, ["k", "k"]), ("a", 2, 60, 5, 1, [], ["k"])], SLIDE)
    got = sorted((str(x.source), x.position, x["count"], x.redundancy) for x in allocation.allocate(df).collect())
    assert got == [("None", 1, 2, 0.0), ("a", 1, 0, 1.0), ("a", 2, 0, 1.0)]
    assert allocation.allocate(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("name", ["T22_salvage_json", "V06_markup_audit", "C13_joined_lines", "C11_shared_options", "C02_page_chunks", "C06_cost_batches", "J20_suppressed_boxes", "J21_merged_boxes", "W04_allocation"])
def test_study_queries_run_on_whole_tables(spark, name):
    got = all_queries.queries()[name](spark, SF)
    assert got.count() > 0
    if name == "T22_salvage_json":
        assert {r.state for r in got.select("state").distinct().collect()} >= {"raw", "cleaned", "balanced", "largest", "empty_response"}
        assert got.where("found_id <> doc_id").isEmpty()
        assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "J21_merged_boxes":
        assert got.agg(F.sum("boxes")).first()[0] == all_queries.queries()["J20_suppressed_boxes"](spark, SF).count()
