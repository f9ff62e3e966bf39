"""Each operator against a plain in-memory version, over whole small tables with edge rows added."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwright.llm import decontam, fingerprint, jaccard, langid, licenses, packing, pii, queries, substring, tokens

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore " * 400
EDGES = [
    (900001, None), (900002, ""), (900003, " \t\n "), (900004, "one"), (900005, "one two three"), (900006, "$$$ 123"), (900007, LONG),
    (900008, LONG + " tail"), (900009, "ONE two\x0bthree four five six"), (900009, "ONE two\x0bthree four five six"),
    (900010, "All Rights Reserved. CC\n-by all rights; reserved 19.5.4.3 300.1.1.1 1.2.3.4.5.6.7.8 010.0.0.1"),
    (900011, "x@y.zz a.b+c@d-e.f.g..h@i.j +12 (34) 56-78 9 end 4539 1488 0343 6467 and 4539-1488-0343-6468 @ + 4539  1488 0343 6467"),
    (900012, "<|startoftext|> don't we're İstanbul étude 日本語 <|end"), (900013, "İ Kelvin CC BY"), (900014, "日本語"),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame(EDGES, "doc_id long, text string")
    # extra columns with names that operators use inside
    clash = {c: F.lit("x") for c in ("tk", "sig", "words", "key", "block", "row", "spans", "term", "pos", "rep", "salt", "next")}
    return base.unionByName(extra, allowMissingColumns=True).withColumns(clash).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return SPACE.findall(text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_substring(docs, rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert any(x[2] for x in want)


def test_index_against_naive():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(1, 4, rng.integers(13, 30)).astype(np.uint64) for _ in range(150)]
    seqs += [s.copy() for s in seqs[:30]] + [np.concatenate((s[:14], s[1:])) for s in seqs[:40]]
    holder = rng.permutation(len(seqs)).astype(np.int64)
    low_ = {}
    for s, h in zip(seqs, holder):
        for i in range(len(s) - 12):
            low_[s[i : i + 13].tobytes()] = min(h, low_.get(s[i : i + 13].tobytes(), h))
    got = substring.smallest_holders(seqs, holder, 13)
    assert all(got[x][i] == low_[s[i : i + 13].tobytes()] for x, s in enumerate(seqs) for i in range(len(s) - 12))


def test_jaccard(docs, rows):
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = sorted((i, len(sets[i]), root(i)) for i, _ in rows)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect())
    assert got == want
    assert any(i != c for i, _, c in want)


def test_jaccard_large_near_group(spark, monkeypatch):
    """A group of near copies around the threshold, in tiles of several blocks."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 40)
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 30)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        t = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 7)):
            t[k] = f"x{rng.integers(0, 50)}"
        texts.append((i, " ".join(t)))
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) for w in (t.split() for _, t in texts)]
    label = list(range(150))
    moved = True
    while moved:
        moved = False
        for a in range(150):
            for b in range(150):
                if label[b] < label[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b]
                    moved = True
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label))


def test_tokens_and_packing(docs, rows):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    ids = [e.ids for e in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    want = sorted((i, len((t or "").encode()), len(e), len(e) > 2048) for (i, t), e in zip(rows, ids))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path).collect()) == want

    pieces = packing.pack_documents(docs, path).collect()
    whole = {}
    for (i, _), e in zip(rows, ids):
        whole.setdefault(i, []).append(np.array(e + [1], "<u4"))
    covered, used = {}, {}
    for p in pieces:
        e = whole[p.doc_id][0]
        assert p.doc_tokens == len(e) and zlib.crc32(e[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
        used.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, texts in whole.items():
        parts = sorted(covered[i])
        assert sum(n for _, n in parts) == sum(map(len, texts))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, [x for v in whole.values() for x in v]))
    assert total / (2048 * len(used)) > 0.9


def test_prefix_counts(spark, docs, rows):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [(i, (t or "")[:120]) for i, t in rows[-20:]]
    got = {(r.doc_id): r.prefix_tokens for r in tokens.count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), path, prefixes=True).collect()}
    for i, t in texts:
        assert got[i] == [len(e.ids) for e in library.encode_batch([t[:k] for k in range(len(t) + 1)], add_special_tokens=False)]


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2049, 300)
    bins, offsets = packing.first_fit_decreasing(sizes)
    free, want = [], np.zeros(300, int)
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(2048)
        want[i] = k
        free[k] -= sizes[i]
    assert (bins == want).all()


def test_licenses(docs, rows):
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    templates = [(label, set(licenses.template_tokens(t))) for label, t in licenses.TEMPLATES]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in rows:
        w = pattern.findall(low(t))
        places = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        base = {label for _, label in places}
        more, best = set(), 0.0
        for line in low(t).split("\n"):
            held = set(pattern.findall(line))
            for label, tokens_ in templates:
                if 100 * len(held & tokens_) >= 80 * len(tokens_):
                    more.add(label)
                    best = max(best, len(held & tokens_) / len(tokens_))
        starts = [k for k, _ in places]
        want.append((i, len(w), len(places), min(starts, default=-1), max(starts, default=-1), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best))
    got = [(r.doc_id, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(docs).collect()]
    assert sorted(got) == sorted(want)


def test_wrapped_licenses(spark):
    """A notice is found however its lines are wrapped; its words scattered over many lines are none."""
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    texts = ["start here\n" + bsd.replace("without ", "without\n") + " provided that\nmore", bsd.replace(" ", "\n * "), "\n".join(f"{w} " + "other words " * 20 for w in bsd.split())]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("bsd", 1.0), 1: ("bsd", 1.0), 2: ("", 0.0)}


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii(docs, rows):
    want = []
    for i, t in rows:
        s = base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((i, *[sum(x[0] == k for x in s) for k in ("email", "ip", "card", "phone")], hashlib.sha256(text.encode()).hexdigest()))
    got = pii.digest(pii.find_spans(docs)).collect()
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert all(sum(w[k] for w in want) for k in (1, 2, 3, 4))


def test_pii_terms(spark):
    """A word that stands only by one address gives it away; a word that stands everywhere does not."""
    texts = [(i, f"the agent Brunhilde{'x' * (i % 3)} Ottokar wrote to the desk\nat note {i} b.o@example.com the end {i * 7}") for i in range(6)]
    texts += [(10 + i, f"the weather is the same {i} and the end of it") for i in range(30)]
    df = spark.createDataFrame([(i, t.replace("\n", " ")) for i, t in texts], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find_spans(df, 3, 0.85)).collect()}
    first = texts[0][1].replace("\n", " ")
    at = first.index("desk")
    assert f"term:{at}:{at + 4}" in spans[0]
    at = first.index("the end")
    assert f"term:{at}:{at + 3}" not in spans[0]
    assert all("term" not in spans[10 + i] for i in range(30))
    cleaned = {r.doc_id: r.text for r in pii.sanitise(df, 3, 0.85).collect()}
    assert "[EMAIL]" in cleaned[0] and "desk" not in cleaned[0] and cleaned[10] == texts[6][1]


def test_pii_terms_of_whole_texts(spark):
    """A name on the line above the address and far from it discloses it, and is marked at all its places in all texts."""
    far = "filler words stand here " * 10
    texts = [(i, f"Wendelgard came\n{far}{i} w.g@example.org end\n{far}said WENDELGARD") for i in range(4)]
    texts += [(4, "a text of Wendelgard without it"), *[(10 + i, f"{far}{i} and the end") for i in range(40)]]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.digest(pii.find_spans(df, 3, 0.85)).collect()}
    for i, t in texts:
        assert {f"term:{m.start()}:{m.end()}" for m in re.finditer("wendelgard", t.lower())} <= set(spans[i])
        assert i < 10 or not spans[i]
    assert not [t for t in (r.text for r in pii.sanitise(df, 3, 0.85).collect()) if "wendelgard" in t.lower()]


def test_fingerprints(docs, rows):
    got = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: (r.doc_id, r.n_chars))
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert len(got) == len(order)
    prints = {}
    errors = []
    for k, ((i, t), r) in enumerate(zip(order, got)):
        t, after = t or "", order[k - 1][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.doc_id == i and r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        count = lambda x: {w: words(x).count(w) for w in set(words(x))}
        if len(t) < 20_000:
            a, b = count(t), count(edited)
            both = sum(min(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
            most = sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
            errors.append(r.near_edited - (both / most if most else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.square(errors)) < 0.01


def test_decontamination(spark, docs, rows):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, re.findall(r"[^\W_]+", (r.text or "").lower())) for r in bench.collect()]
    planted = []
    for n, (item, w) in enumerate(items[:12]):
        v = list(w)
        for k in range(3, len(v), 6):
            v[k] = "zzz"
        planted.append((910000 + n, "before it goes " + " ".join(v) + " and after it"))
    whole = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(whole, bench).collect()}
    want = set()
    for i, t in [*rows, *planted]:
        d = np.array(re.findall(r"[^\W_]+", (t or "").lower()), object)
        for item, b in items:
            size = min(20, len(b))
            if len(b) < 8 or len(d) < 8 or not set(b) & set(d):
                continue
            b = np.array(b, object)
            for shift in range(-len(b) + 1, len(d)):
                lo, hi = max(0, -shift), min(len(b), len(d) - shift)
                if 100 * (hi - lo) < 80 * size:
                    continue
                run = np.concatenate(([0], np.cumsum(d[lo + shift : hi + shift] == b[lo:hi])))
                window = min(size, hi - lo)
                if 100 * (run[window:] - run[:-window]).max() >= 80 * size:
                    want.add((i, item))
                    break
        if len(d) > 5000:
            continue
    assert got == want
    assert len([p for p in want if p[0] >= 910000]) == 12


def test_language(spark):
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(labelled.where(~langid.held_out()))
    got = labelled.join(langid.identify(labelled, model).withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).where(langid.held_out()).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$$"), (4, "the of and日本")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(odd, model).orderBy("doc_id").collect()][:3] == ["und"] * 3
    empty = langid.fit(labelled.where("false"))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(60):
        score = -rng.integers(0, 9, (6, 3)).astype(float)
        path = langid.viterbi(score, 4.0)
        value = lambda p: sum(score[i, x] for i, x in enumerate(p)) - 4.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
        assert value(path.tolist()) == max(value(p) for p in product(range(3), repeat=6))
    mixed = np.array([[0, -3]] * 10 + [[-3, 0]] * 10, float)
    assert langid.viterbi(mixed, 5.0).tolist() == [0] * 10 + [1] * 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    path = queries.tokenizer_path("word_bpe_49k.json")
    bench = spark.createDataFrame([], "item_id long, text string")
    for frame in (
        substring.remove_repeats(none), pii.digest(pii.find_spans(none)), packing.pack_documents(none, path), jaccard.jaccard_classes(none), licenses.scan(none),
        langid.identify(none, langid.fit(none)), fingerprint.fingerprints(none), tokens.count_tokens(none, path), decontam.contaminated(none, bench), pii.sanitise(none),
    ):
        assert frame.collect() == []
