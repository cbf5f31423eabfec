"""Spelling variants, licence scans and ranked search against plain versions, and rows of every odd kind."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strata.llm import licences, ranked, spelling
from strata.session import written

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (0, None), (1, ""), (2, " \n\t"), (3, "Ünïcode ÀÖ×÷ straße STRASSE 日本 naïveté"), (4, "colour colours color " * 9), (4, "colour colours color " * 9), (None, "without an id " * 7),
    (5, "w" * 5000 + " " + "abcdefgh " * 30), (6, "released under the MIT License.\nreleased under the MIT license"), (7, " ".join(f"word{k % 701}" for k in range(200_000))),
]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n, times=5):
    near = defaultdict(set)
    by_gap = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by_gap[w[:k] + "*" + w[k + 1 :]].add(w)
        for k in range(len(w)):
            if (short := w[:k] + w[k + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
    for same in by_gap.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def told(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def documents(spark, folder=FOLDER):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_variants_against_plain(spark):
    assert told(spelling.query(spark, FOLDER)) == plain_variants(plain_counts(documents(spark)))
    odd = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, key long, word string")
    got = told(spelling.variants(written(spelling.counted(odd), "v")))
    assert got == plain_variants(plain_counts(ODD)) and any(r[0] == "colours" for r in got)


def test_plain_near_is_one_edit():
    n = plain_counts([(k, f"{w} " * 6) for k, w in enumerate("colour colours color kolour colourss".split())])
    near = {r[0]: r[4] for r in plain_variants(n)}
    assert near == {w: sum(one_edit(w, x) for x in n) for w in n}


def crowd(seed=3, many=400):
    """Words of a few letters, most of which share a reduced word with others, and chains of forms."""
    rng = random.Random(seed)
    of = defaultdict(list)
    for c, s in zip(spelling.ALPHABET.tolist(), spelling.symbols(spelling.ALPHABET, spelling.SYMBOLS).tolist()):
        of[s].append(chr(c))
    alike = max(of.values(), key=len)[:4] + list("ab")
    words = {"".join(rng.choices(alike, k=rng.randrange(6, 9))) for _ in range(many)}
    return {w: rng.choice([1, 1, 2, 7, 40, 300]) for w in words}


@pytest.mark.parametrize("most", [1, 3, 64])
def test_crowded_reduced_words(spark, most):
    n = crowd()
    table = written(spark.createDataFrame(list(n.items()), "word string, n long"), "crowd")
    assert told(spelling.variants(table, most=most)) == plain_variants(n)


def test_forms_lead_to_roots(spark):
    n = {"a" * 6 + "b" * k: 6**k for k in range(9)}
    table = written(spark.createDataFrame(list(n.items()), "word string, n long"), "chain")
    got = {r[0]: r[2] for r in told(spelling.variants(table))}
    assert set(got.values()) == {"a" * 6 + "b" * 8}


# Licence scans


def plain_base(text):
    words = plain_words(text)
    return sorted((label, i) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def test_base_places_against_plain(spark):
    for r in licences.query(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect():
        base = plain_base(r["text"])
        starts = [i for _, i in base]
        assert (r["n_words"], r["n_base"]) == (len(plain_words(r["text"])), len(base))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for x, _ in base})) and set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_matching_statistics_against_plain():
    rng = random.Random(5)
    for _ in range(60):
        templates = [("x", " ".join(rng.choices("abc", k=rng.randrange(2, 14)))) for _ in range(rng.randrange(1, 5))]
        phrases = {" ".join(rng.choices("abc", k=2)): "p", " ".join(rng.choices("abc", k=3)): "q"}
        machine = licences.Automaton(phrases, templates)
        every = [t.split() for t in [*phrases, *(t for _, t in templates)]]
        has = {tuple(t[i:j]) for t in every for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        text = rng.choices("abc", k=60)
        number = {w: k for k, w in enumerate(machine.vocabulary)}
        if not set(text) <= set(number):
            continue
        for i, (state, size) in enumerate(machine.statistics([number[w] for w in text])):
            longest = max(k for k in range(i + 2) if not k or tuple(text[i + 1 - k : i + 1]) in has)
            assert size == longest
            ends = {(k, j) for k, t in enumerate(every) for j in range(size, len(t) + 1) if t[j - size : j] == text[i + 1 - size : i + 1]}
            assert not size or set(machine.ends[state]) == ends
            assert {(n, k) for n, k in machine.said[state] if n <= size} == {(len(p.split()), k) for k, p in enumerate(phrases) if text[max(0, i + 1 - len(p.split())) : i + 1] == p.split()}


def plain_chains(machine, text):
    """Of each template the best cover: over all maximal matches, without the window of recent ones."""
    number = {w: k for k, w in enumerate(machine.vocabulary)}
    best = Counter()
    for k in range(machine.phrases, len(machine.labels)):
        t = machine.told[k]
        matches = []
        for i in range(len(text)):
            for j in range(len(t)):
                n = 0
                while i + n < len(text) and j + n < len(t) and text[i + n] == t[j + n] and text[i + n] in number:
                    n += 1
                if n >= licences.SEED and not (i and j and text[i - 1] == t[j - 1]):
                    matches.append((i, i + n, j))
        had = []
        for a, b, j in sorted(matches, key=lambda m: (m[1], m[0])):
            cover = b - a
            for a2, b2, j2, c2 in had:
                e2 = j2 + b2 - a2
                shared = max(0, b2 - a, e2 - j)
                if b2 >= a - licences.GAP and shared < b - a and j - e2 <= licences.GAP and b2 < b and e2 < j + b - a:
                    cover = max(cover, c2 + b - a - shared)
            had.append((a, b, j, cover))
            best[k] = max(best[k], cover)
    return best


def test_chains_against_plain():
    rng = random.Random(11)
    for _ in range(80):
        templates = [(str(k), " ".join(rng.choices("abcdef", k=rng.randrange(4, 30)))) for k in range(2)]
        machine = licences.Automaton({}, templates)
        number = {w: k for k, w in enumerate(machine.vocabulary)}
        text = [w for _, t in templates for w in t.split() if rng.random() < 0.9 for w in ([w] if rng.random() < 0.9 else [w, "z"])]
        ids = np.array([number.get(w, -1) for w in text], np.int32)
        first, last = machine.runs(ids, np.zeros(len(ids), np.int64))
        want = plain_chains(machine, text)
        found = licences.spans_of(machine, first, last, ids, 0)
        for k, (name, _) in enumerate(templates):
            size = machine.sizes[k]
            enough = size if size <= licences.SHORT else max(licences.SHORT, licences.SHARE * size)
            assert max((s[4] for s in found if s[0] == name), default=0) == (want[k] if want[k] >= enough else 0)


def scan(spark, texts, **more):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["f"] for r in rows.select("doc_id", licences.licence_spans("text", **more).alias("f")).collect()}


def test_changed_licences_are_found(spark):
    rng = random.Random(8)
    texts, want = [], []
    for name, template in licences.TEMPLATES:
        words = template.split()
        if len(words) > 60:
            changed = [w for w in words]
            for k in rng.sample(range(len(words)), len(words) // 20):
                changed[k] = f"other{k}"
            texts.append("Copyright 2020 Some One.\n\n" + "\n * ".join(" ".join(changed[i : i + 9]) for i in range(0, len(changed), 9)).upper())
            want.append(name)
    got = scan(spark, texts)
    for k, name in enumerate(want):
        assert name in {s["label"] for s in got[k]["spans"]}, name


def test_clean_texts_have_no_labels(spark):
    texts = ["He was released under the new rules of the court, and the license of the driver was kept.", "You may not use this file. The software is free of charge.", "general license", "the mit", None, "", "license " * 5000, "under the " * 5000 + "mit", "of the terms of the terms of the license of the " * 500]
    got = scan(spark, texts)
    assert [len(got[k]["spans"]) for k in range(len(texts))] == [0] * len(texts)


def test_long_and_repeated_licences(spark):
    whole = licences.TEMPLATES[0][1]
    noise = " ".join(f"noise{k % 97}" for k in range(1000))
    (found,) = scan(spark, [f"{noise} {whole} " * 300]).values()
    spans = [s for s in found["spans"] if s["label"] == "mit" and not s["phrase"]]
    assert found["n_words"] == 300 * (1000 + len(whole.split())) and len(spans) == 300 and all(s["covered"] == s["words"] for s in spans)
    assert [s["first"] for s in spans] == [1000 + k * (1000 + len(whole.split())) for k in range(300)]


def test_phrases_of_ones_own(spark):
    found = scan(spark, ["a b a b a", "x b a"], phrases={"a b": "one", "b a": "two", "a b a": "three"}, templates=[])
    assert [(s["label"], s["first"]) for s in found[0]["spans"]] == [("one", 0), ("three", 0), ("two", 1), ("one", 2), ("three", 2), ("two", 3)]
    assert [(s["label"], s["first"]) for s in found[1]["spans"]] == [("two", 1)]


# Ranked search


def plain_ranked(docs, items, best=50):
    import math

    sets = defaultdict(set)
    for i, t in items:
        sets[i] |= set(plain_words(t))
    tokens = [(d, Counter(plain_words(t))) for d, t in docs]
    tokens = [(d, c, sum(c.values())) for d, c in tokens if c]
    big_n, total = len(tokens), sum(n for *_, n in tokens)
    df = Counter(w for _, c, _ in tokens for w in c)
    weight = {w: math.floor(1000 * math.log((2 * big_n + 2) / (2 * k + 1))) for w, k in df.items()}
    out = []
    for i, terms in sets.items():
        scored = []
        for row, (d, c, n) in enumerate(tokens):
            m = 50 + 50 * n * big_n // total
            if s := sum(weight[w] * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if w in c):
                scored.append((-s, d is None, d, row))
        out += [(i, r, d, -s) for r, (s, _, d, _) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0, x[3]))[:best], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bundled,owners", [(256, ranked.OWNERS), (2, (0.1, 0.2, 0.5)), (256, ())])
def test_ranked_against_plain(spark, monkeypatch, bundled, owners):
    monkeypatch.setattr(ranked, "DOCS", 7)
    rng = random.Random(1)
    docs = [(k if k % 9 else None, " ".join(rng.choices("abcdefghijklm", k=rng.randrange(40)))) for k in range(150)] + ODD + [(3000 + k, "a b c") for k in range(80)]
    items = [(k, " ".join(rng.choices("abcdefghijklmnop", k=5))) for k in range(9)] + [(3, "zz word7 a"), (None, "MIT License a"), (50, None), (51, ""), (52, "qqqq")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item long, score long").repartition(3)
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.ranked(d, spark.createDataFrame(items, "item_id long, text string"), bundled=bundled, owners=owners).collect()), key=str)
    assert got == plain_ranked(docs, items)


def test_ranked_of_empty_tables(spark):
    some = spark.createDataFrame(ODD, "doc_id long, text string")
    items = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    assert ranked.ranked(some.where("false"), items).count() == 0
    assert ranked.ranked(some, items.where("false")).count() == 0
    assert ranked.ranked(some.where("text IS NULL"), items).count() == 0
