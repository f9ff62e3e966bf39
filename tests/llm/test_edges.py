"""Rows that are easily lost: repeated and null ids, short items, clashing column names; and whole operators against plain versions."""

import hashlib
import itertools
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwright.llm import decontam, html, jaccard, langid, licenses, pii, substring
from shelfwright.llm.common import save

SOME = [f"w{i}" for i in range(400)]


def leaks(docs, items):
    """Plain version: all alignments of all pairs."""
    out = set()
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for (i, t), (k, b) in itertools.product(docs, items):
        d, b = cut(t), cut(b)
        size = min(20, len(b))
        need = 100 if len(b) < 8 else 80
        if len(b) < 3:
            continue
        for shift in range(-len(b) + 1, len(d)):
            e = [0 <= j + shift < len(d) and d[j + shift] == b[j] for j in range(len(b))]
            if any(100 * sum(e[j : j + size]) >= need * size for j in range(len(b) - size + 1)):
                out.add((i, k))
                break
    return out


def test_leaks_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(rng.choice(SOME, n))
    u, v, w, x, y = words(30), words(24), words(9), "alpha beta gamma delta", "one two"
    items = [(1, u), (1, v), (None, w), (None, u), (2, x), (3, y), (4, words(16)), (4, None), (None, "")]

    def broken(text, every):
        parts = text.split()
        return " ".join("zz" if k % every == every - 1 else p for k, p in enumerate(parts))

    docs = [(1, f"{words(5)} {u} {words(5)}"), (1, f"{words(5)} {v}"), (None, f"a {broken(v, 6)} b"), (None, words(40)), (2, f"q {x} q"), (3, f"q {broken(x, 4)} q"), (4, y), (5, broken(w, 9)), (6, broken(items[6][1], 6) + " and more"), (7, None), (8, ""), (9, x), (None, f"a {broken(v, 6)} b")]
    docs += [(100 + k, words(60)) for k in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("tk", "bad_id", "bad_tk", "words", "pos", "seed", "item_id")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("ik", "item", "doc_id")})
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == leaks(docs, items)
    assert {(1, 1), (1, None), (None, 1), (2, 2), (9, 2), (5, None), (6, 4)} <= got and (3, 2) not in got
    bad = {t for i, t in docs if any(leaks([(i, t)], items))}
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t in docs if t not in bad)


def test_every_admitted_substitution_is_found():
    """For items of any length: whichever fifth of the words (of a window of twenty) is substituted, some mask sees none of them."""
    for n in range(decontam.SPAN, 21):
        masks = [m for m in decontam.MASKS] + ([decontam.SHORT_MASK] if n < decontam.LONG else [])
        laid = [{p + o for o in m} for m in masks for p in range(n) if p + m[-1] < n]
        lost = min(n, 20) - -(-80 * min(n, 20) // 100)
        assert all(any(not (set(gone) & m) for m in laid) for gone in itertools.combinations(range(n), lost)), n


def test_jaccard_with_repeated_and_null_ids(spark):
    rng = np.random.default_rng(9)
    base = [list(rng.choice(SOME, 60)) for _ in range(4)]

    def near(k):
        t = list(base[k])
        t[int(rng.integers(0, 60))] = "zz"
        return " ".join(t)

    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (7, near(0)), (3, near(1)), (None, " ".join(base[2])), (None, near(2)), (None, " ".join(base[3])), (9, near(3)), (1, None), (1, ""), (2, "one"), (None, "one")]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or frozenset([tuple(w)] if w else []) for w in ((t or "").split() for _, t in rows)]
    label = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    least = {l: min((rows[k][0] for k in range(len(rows)) if label[k] == l and rows[k][0] is not None), default=None) for l in label}
    want = Counter((i, len(sets[k]), least[label[k]]) for k, (i, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("tk", "rep", "sig", "own", "at", "first")})
    assert Counter(tuple(r) for r in jaccard.jaccard_classes(df).collect()) == want
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({5: 1, 3: 1, None: 1, 9: 1, 1: 2, 2: 1})


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_pivots(spark, monkeypatch, seed):
    """A template's near copies, a second template near the first, and sets that only share a part, with pivots and many small blocks."""
    for name, value in (("PIVOT_ROWS", 12), ("TILE_ROWS", 25), ("UNIT_ROWS", 20), ("PIVOTS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(seed)
    first = list(rng.choice(SOME, 110))
    second = [w if k % 20 else "other" for k, w in enumerate(first)]
    rows = []
    for k in range(140):
        t = list(first if k % 3 else second)
        for j in rng.integers(0, 110, rng.integers(0, 6)):
            t[j] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(t)))
    rows += [(200 + k, " ".join(first[:30] + list(rng.choice(SOME, 20)))) for k in range(30)]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for a, b in itertools.combinations(range(len(rows)), 2):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: rows[label[k]][0] for k, (i, _) in enumerate(rows)}
    assert len(set(got.values())) < len(rows) - 60


def test_matching_statistics():
    """The longest run from each place that stands elsewhere too, against all pairs of places."""
    rng = np.random.default_rng(6)
    seqs = [rng.integers(1, 4, rng.integers(13, 24)).astype(np.uint64) for _ in range(40)]
    seqs += [np.concatenate((s[2:], s[:9])) for s in seqs[:15]] + [s.copy() for s in seqs[:5]]
    runs = Counter(tuple(s[i : i + k]) for s in seqs for i in range(len(s)) for k in range(1, min(16, len(s) - i) + 1))
    where = [(k, i) for k, s in enumerate(seqs) for i in range(len(s))]
    got, low, high = substring.FMIndex(seqs).matching_statistics(*(np.array(x) for x in zip(*where)), 7)
    for (k, i), n, a, b in zip(where, got.tolist(), low.tolist(), high.tolist()):
        s = seqs[k]
        assert n == max((m for m in range(1, min(16, len(s) - i) + 1) if runs[tuple(s[i : i + m])] > 1), default=0)
        assert n < 7 or b - a == runs[tuple(s[i : i + 7])]


def test_license_bodies(spark):
    """A license's body, wrapped as files have it, and the same words scattered."""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software."""
    isc = "Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided that"
    apache = """ * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
    texts = [mit, isc, apache, "\n".join(f"{w} " + "filler words of other lines " * 15 for w in mit.split()), "the software is provided by us"]
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: {"mit"}, 1: {"isc"}, 2: {"apache-2.0"}, 3: set(), 4: set()}


def test_stages_with_clashing_columns(spark, tmp_path):
    names = ["tk", "found", "stay", "id", "key", "spans", "told", "share", "own", "at", "bad_id", "other_id", "_found", "_id", "_tk", "_key", "_spans", "lang_pred", "lang_score", "block", "seed", "words"]
    rows = [(k, f"the of and to in text number {k} alpha beta a{k}@example.org", "en", "s", 10) for k in range(6)] + [(None, "the of and", "en", None, None), (6, None, None, "s", 0), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit(n) for n in names})
    spark.createDataFrame([(1, "nothing of this stands in any of these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = save(stage(spark, docs, str(tmp_path)))
        if name != "pack":
            assert out.columns == docs.columns
            assert all(r[n] == n for r in out.collect() for n in names)
            docs = out
    assert out.count() == docs.count()
    odd = docs.withColumns({n: F.lit("x") for n in ("lang_pred", "score", "held_out")})
    assert set(langid.identify(odd, langid.fit(odd)).columns) == {"doc_id", "lang_pred", "score"}


def test_language_operator_against_plain_version(spark):
    """Scores, switching and shares of the whole operator, word by word in plain Python, from the learned tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    extra = spark.createDataFrame([(-1, "the and of with les des une pour " * 6), (-2, "日本語 the of"), (-3, None), (-4, "12 %% --"), (-5, "der die und das " * 30 + "the of and to " * 30)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    k = len(model.langs)

    def word_score(w):
        letters = [c for c in w if c.isalpha()]
        if not letters:
            return [0.0] * k, 0
        names = [langid.SCRIPTS[max(i for i, (s, _) in enumerate(langid.SCRIPTS) if s <= ord(c))][1] for c in letters]
        top = min(set(names), key=lambda n: (-names.count(n), langid.NAMES.index(n)))
        admits = model.admits[:, langid.NAMES.index(top)]
        if not admits.any():
            return [0.0] * k, len(letters)
        bucket, _ = langid.grams([w.encode().lower()])
        total = model.logp[bucket].astype(float).sum(0) / langid.OVERLAP
        best = max(t for t, a in zip(total, admits) if a)
        return [max(t - best, langid.WORST) if a else langid.WORST for t, a in zip(total, admits)], len(letters)

    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        scored = [word_score(w) for w in (t.decode() for t in (r.text or "").encode().split())]
        total = sum(n for _, n in scored)
        if not total:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        best, back = list(scored[0][0]), []
        for s, _ in scored[1:]:
            step = [max(range(k), key=lambda y: best[y] - (langid.SWITCH if y != x else 0)) for x in range(k)]
            back.append(step)
            best = [best[step[x]] - (langid.SWITCH if step[x] != x else 0) + s[x] for x in range(k)]
        x = max(range(k), key=lambda y: best[y])
        share = [0] * k
        for (_, n), step in zip(reversed(scored), [*reversed(back), None]):
            share[x] += n
            x = step[x] if step else x
        assert got[r.doc_id].lang_pred in {model.langs[y] for y in range(k) if share[y] >= max(share) - 0.02 * total}
        assert abs(got[r.doc_id].score - max(share) / total) < 0.03


def test_terms_against_plain_counts(spark):
    """Which words are marked, from counts over the distinct texts of a whole table."""
    rng = np.random.default_rng(4)
    people = [f"person{chr(97 + k)}" for k in range(6)]
    texts = []
    for n in range(160):
        words = list(rng.choice(["apple", "river", "stone", "cloud", "green", "seven"], 8))
        if n % 3 == 0:
            k = int(rng.integers(0, 6))
            words.insert(int(rng.integers(0, 8)), f"p{k}@example.org")
            if rng.random() < 0.9:
                words.insert(0, people[k].upper() if n % 2 else people[k])
        elif n % 17 == 0:
            words.append(people[n % 6])
        texts.append(" ".join(words))
    texts += texts[:5]
    held, words = defaultdict(set), defaultdict(set)
    for t in set(texts):
        spans = [m.group().lower() for m in re.finditer(r"\S+@\S+", t)]
        rest = set(re.findall(r"[^\W\d_]{3,}", re.sub(r"\S+@\S+", " ", t).lower()))
        for e in spans:
            held[e].add(t)
        for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())):
            words[w].add(t)
        for e in spans:
            for w in rest:
                held[e, w].add(t)
    total, want = len(set(texts)), set()
    for key, where in held.items():
        if isinstance(key, tuple) and len(where) >= 3 and len(held[key[0]]) >= 3:
            told = 1 + math.log(len(where) / len(words[key[1]])) / math.log(total / len(held[key[0]]))
            if told >= 0.85:
                want.add(key[1])
    assert want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = set()
    for r in pii.digest(pii.find_spans(df)).collect():
        for a, b in re.findall(r"term:(\d+):(\d+)", r.spans):
            marked.add(texts[r.doc_id][int(a) : int(b)].lower())
    assert marked == want
    cleaned = [r.text for r in pii.sanitise(df).collect()]
    assert not any(w in t.lower() for t in cleaned for w in want)


def test_terms_of_texts_repeated_many_times(spark):
    """Copies change no term: every text ten times, and one of them a thousand times."""
    texts = [f"the note {k} of marlowe to p1@example.org" for k in range(3)] + [f"filler text number {k} of the note" for k in range(100)]
    spans = {}
    for name, rows in (("once", texts), ("ten", texts * 10), ("hot", texts + texts[:1] * 1000)):
        found = pii.digest(pii.find_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()
        spans[name] = {rows[r.doc_id]: r.spans for r in found}
    assert spans["once"] == spans["ten"] == spans["hot"]
    assert all("term" in spans["once"][t] for t in texts[:3])


def test_many_spans_in_one_text(spark):
    """Tens of thousands of values and terms in one text are found and replaced in seconds."""
    n = 40_000
    text = " ".join(f"marlowe{'x' * (k % 2)} u{k}@example.org" for k in range(n))
    rows = [(0, text)] + [(k, f"marlowe at the desk {k} u{k}@example.org u7@example.org") for k in range(1, 5)] + [(10 + k, f"other words {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    row = next(r for r in pii.digest(pii.find_spans(df)).collect() if r.doc_id == 0)
    found_in = time.time() - start
    assert row.n_email == n and row.n_term >= n // 2
    ends = [m.span() for m in re.finditer(r"u\d+@example\.org", text)]
    assert row.base_sha256 == hashlib.sha256(",".join(f"email:{a}:{b}" for a, b in ends).encode()).hexdigest()
    start = time.time()
    cleaned = next(r.text for r in pii.sanitise(df).collect() if r.doc_id == 0)
    assert cleaned.count("[EMAIL]") == n and "@" not in cleaned and "marlowe " not in cleaned
    assert found_in < 90 and time.time() - start < 120, (found_in, time.time() - start)


def test_replaced_against_plain(spark):
    """Texts with any spans, overlapping ones too."""
    rng, rows = np.random.default_rng(8), []
    for k in range(60):
        text = "".join(rng.choice(list("abcdé😀 "), 80))
        cuts = [sorted(rng.integers(0, 81, 2).tolist()) for _ in range(int(rng.integers(0, 30)))]
        rows.append((k, text, [(0, a, b, None) for a, b in cuts if a < b]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, spans {pii.SPAN}")
    got = {r.doc_id: r.out for r in df.select("doc_id", pii.replaced(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("<"), s["start"].cast("string"), F.lit(">"))).alias("out")).collect()}
    for k, text, spans in rows:
        at, out = 0, ""
        for _, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += text[at:a] + f"<{a}>"
            at = max(at, b)
        assert got[k] == out + text[at:]


def test_wrappers_never_trained_on(spark):
    """Comments, adverts and notices after an article, in wrappers whose names no training page has. Their texts are the article's own."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id < 1060").orderBy("page_id").collect()]
    model = html.train(pages[:200])
    wrap = lambda tag, inside, deep: f"<{tag}>" + '<div class="row px-3">' * deep + inside + "</div>" * deep + f"</{tag.split()[0]}>"
    names = ['div class="user-responses"', 'div id="disqus_thread"', 'div class="advertisement"', 'div class="gdpr"', 'div class="subscribe"', 'div class="kommentare"', "section", "div"]
    for article, floor in (("article", 0.99), ('div class="zeitung"', 0.9)):
        kept = right = all_ = 0
        for n, page in enumerate(pages[1000:1060]):
            texts = [t for t, path, _ in html.blocks(page) if html.weak_label(path) == 1.0]
            part = lambda xs: "".join(f"<p>{html.entities.escape(t)}</p>" for t in xs)
            found = html.blocks("<html><body>" + wrap(article, part(texts), 4 * (n % 2)) + wrap(names[n % len(names)], part(texts[:3]), 4 * (n % 2)) + "</body></html>")
            y = model.label([html.vectors(found)])[0] >= 0.5
            kept, right, all_ = kept + y.sum(), right + y[: len(texts)].sum(), all_ + len(texts)
        assert right / kept >= floor and right / all_ >= floor, (article, right / kept, right / all_)
