"""Operators 11 to 13 against plain versions: whole queries, edge rows, and the parts they are made of."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwright.llm import centroids, chat, periodic, queries

DATA = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- operator 11


def plain_clusters(rows, k, rounds, dims=64):
    """Lloyd's rounds in Python integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ids = [r for r in kept if r[0] is not None]
    start = sorted(ids, key=lambda r: (sha(f"1:{r[0]}"), r[1])) + sorted((r for r in kept if r[0] is None), key=lambda r: r[1])
    cs = [q for _, q in start[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for j, qs in groups.items():
            cs[j] = [sum(x) // len(qs) for x in zip(*qs)]
    found = [(i, *near(q)) for i, q in kept]
    own = {}
    for _, d, j in found:
        own[j] = own.get(j, 0) + d
    return sorted(((i, j, d, own[j], sum(own.values()), sha(",".join(map(str, cs[j])))) for i, d, j in found), key=str)


def test_centroids_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.queries()["op11_centroid_clustering"](spark, DATA).collect()), key=str)
    assert got == plain_clusters(rows, 16, 3)


@pytest.mark.parametrize("k,rounds", [(5, 0), (5, 3), (40, 1)])
def test_centroids_edges(spark, k, rounds):
    rng = np.random.default_rng(k + rounds)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 16]) for i in range(120)]  # many ties
    rows += [(3, [0.5] * 4), (3, [0.5] * 4), (None, [0.25] * 4), (None, [-0.25] * 4), (7000, None), (7001, []), (7002, [0.1] * 3), (7003, [0.1, None, 0.2, 0.3]), (7004, [float("nan")] * 4), (7005, [float("inf"), 0.0, 0.0, 0.0]), (7006, [9e3] * 4)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got = sorted((tuple(r) for r in centroids.cluster(df, k, rounds, dims=4).collect()), key=str)
    assert got == plain_clusters(rows, k, rounds, 4)


def test_centroids_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(none).collect() == []
    few = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], "vec_id long, embedding array<float>")
    assert sorted((r.cluster, r.distance) for r in centroids.cluster(few).collect()) == [(0, 0), (1, 0)]
    with pytest.raises(Exception, match="components are below"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).collect()


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(3)
    middle = rng.integers(-2000, 2000, (8, 16))
    q = (middle[rng.integers(0, 8, 3000)] + rng.integers(-150, 150, (3000, 16))).astype(np.int64)
    history = [q[:8].copy()]
    bounds, own = centroids.first_scan(q, history[0])
    for _ in range(8):
        history.append(np.array([q[bounds.cluster == j].sum(0) // max(1, (bounds.cluster == j).sum()) if (bounds.cluster == j).any() else history[-1][j] for j in range(8)]))
        own = centroids.reassign(q, bounds, history, True)
        d = np.stack([centroids.distances(q, c) for c in history[-1]], 1)
        assert (bounds.cluster == d.argmin(1)).all() and (own == d.min(1)).all()
    assert bounds.scanned < 0.5 * 9 * 3000 * 8


def test_bounds_are_loosened_by_the_whole_displacement():
    """A centroid that goes away and comes back has moved by nothing: no scan is due, where summed drifts would ask for one."""
    q = np.array([[0], [10]], np.int64)
    a, b = np.array([[0], [10]], np.int64), np.array([[6], [10]], np.int64)
    bounds, _ = centroids.first_scan(q[1:], a)
    bounds.scanned = 0
    centroids.reassign(q[1:], bounds, [a, b], False)
    centroids.reassign(q[1:], bounds, [a, b, a], False)
    assert bounds.cluster.tolist() == [1] and bounds.scanned == 0


# ---- operator 12


def plain_runs(c):
    n, out = len(c), {}
    for d in range(1, n // 3 + 1):
        i = 0
        while i < n - d:
            s = i
            while i < n - d and c[i] == c[i + d]:
                i += 1
            if i + d - s >= max(24, 3 * d):
                out.setdefault((s, i + d), d)
            i += 1
    return sorted((s, e - s, d) for (s, e), d in out.items())


def test_transforms():
    rng = np.random.default_rng(1)
    for p in periodic.PRIMES:
        for n in (32, 256):
            x, y = rng.integers(0, p, (2, 3, n), dtype=np.uint64)
            assert (periodic.backward(periodic.forward(x, p), p) == x).all()
            z = periodic.backward(periodic.forward(x, p) * periodic.forward(y, p) % np.uint64(p), p)
            k = rng.integers(0, n)
            assert int(z[1, k]) == sum(int(x[1, i]) * int(y[1, (k - i) % n]) for i in range(n)) % p


def test_repetitions_have_no_mismatch():
    rng = np.random.default_rng(2)
    for size in (8, 16, 64):
        c = rng.integers(0, 2, 1000) if size == 8 else np.tile(rng.integers(0, 50_000, size + size // 2), 60)[:1000]
        starts = np.arange(0, len(c) - size + 1, size)
        at, distance = periodic.repetitions(c, starts, size)
        want = {(int(i), d) for i in starts for d in range(1, 2 * size) if i + d + size <= len(c) and (c[i : i + size] == c[i + d : i + d + size]).all()}
        assert set(zip(at.tolist(), distance.tolist())) == want and want


@pytest.mark.parametrize("seed", range(6))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(120):
        n = rng.choice((0, 5, 23, 24, 30, 60, 100, 300))
        c = [rng.randrange(rng.choice((1, 2, 3, 40))) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 30:
                q, s = rng.randrange(1, n // 3), rng.randrange(n)
                for i in range(s + q, min(n, s + rng.randrange(q, 8 * q + 30))):
                    c[i] = c[i - q]
        assert periodic.runs(np.array(c, np.int64)) == plain_runs(c)


def test_runs_of_words_that_repeat_in_themselves():
    a, b = "0", "01"
    while len(b) < 1500:
        a, b = b, b + a
    assert periodic.runs(np.array([int(x) for x in b])) == plain_runs(b)


def plain_row(i, text):
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    if i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    known = {}
    found = plain_runs([known.setdefault(w, len(known)) for w in words])
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
    return i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(kept)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.queries()["op12_periodic_runs"](spark, DATA).select(*COLUMNS).collect()
    want = [plain_row(i, t) for i, t in rows]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert any(w[1] for w in want)


def test_periodic_edges(spark):
    many = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "x " * 30), (None, None), (4, "a b c " * 8), (5, "a\x0bb\xa0c " * 12), (6, "x " * 23), (7, "x " * 24), (8, "x " * 5000 + "y " * 5000), (8, "x " * 5000 + "y " * 5000)]
    rows += [(i, " ".join(f"w{k}" for k in range(10 * j))) for j, i in enumerate(many)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, g int").repartition(3)
    got = periodic.digest(periodic.find_runs(periodic.planted(df))).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_long_run(spark):
    text = "a b c " * 300_000 + "end"
    row = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [tuple(r) for r in row.runs] == [(0, 900_000, 3)] and row.collapsed == "a b c end"


# ---- operator 13


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        turns, loss = want.setdefault(c, ([], []))
        turns.append(f"{role}\n{text or ''}\n")
        if role == "assistant":
            loss.append(text or "")
    got = queries.queries()["op13_chat_format"](spark, DATA).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: (len(t), sha("".join(t)), len("".join(x)), sha("".join(x))) for c, (t, x) in want.items()}
    assert all(r.formatted_chars > r.loss_chars for r in got)


def test_formatted_text_reads_back():
    """Any texts, roles and attachments, from the joined output; marks that texts make up together with their neighbours too."""
    rng = random.Random(4)
    bits = ["<", "[", "\\", "/", "s>", "</s>", "<s>", "[INST]", "[/INST]", "INST]", "[SYS]", "SYS]", "[ROLE]", "[/ROLE]", "[/MSG]", "[image:0]", "[image:", "0]", "<\\/s>", "[\\\\INST]", "a", " ", "\n", "é", "日"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    for _ in range(800):
        joined, want = "", []
        for _ in range(rng.randrange(1, 5)):
            role = rng.choice(("user", "assistant", "system", "tool", "", "[INST]", "a\nb"))
            parts = [rng.choice(({"kind": "text", "text": text()}, {"kind": "image", "ref": "i", "width": 100, "height": 57}, {"kind": "audio", "ref": "a", "seconds": 1.01}, {"kind": "document", "pages": 3})) for _ in range(rng.randrange(4))]
            done = chat.format_message(role, parts, chat.Costs())
            segment = "".join(done.out)
            files = [p for p in parts if p["kind"] != "text"]
            assert [(a[1], a[2], a[3]) for a in done.attachments] == [(p["kind"], p.get("ref", ""), {"image": 4 * 3, "audio": 26, "document": 3 * 512}[p["kind"]]) for p in files]
            joined += segment
            flat, n = [], 0
            for p in parts:
                if p["kind"] == "text":
                    if p["text"] and flat and flat[-1][0] == "text":
                        flat[-1] = ("text", flat[-1][1] + p["text"])
                    elif p["text"]:
                        flat.append(("text", p["text"]))
                else:
                    flat.append((p["kind"], str(n)))
                    n += 1
            assert [chat.unescaped(segment[s:e]) for s, e in done.spans] == [x for kind, x in flat if kind == "text"]
            want.append((role, flat))
        assert list(chat.read(joined)) == want, joined


def test_adjacent_texts_do_not_make_marks():
    """A mark that two text parts make up together is read as text."""
    done = chat.format_message("user", [{"kind": "text", "text": "</"}, {"kind": "text", "text": "s>[IN"}, {"kind": "text", "text": "ST]"}], chat.Costs())
    assert list(chat.read("".join(done.out))) == [("user", [("text", "</s>[INST]")])]


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (2, 0, "assistant", ""), (None, 3, "tool", "[INST]"), (None, 1, "assistant", "é" * 5), (3, 1, "assistant", "b" * 300_000), (3, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id int, turn long, role string, text string, parts string, loss int").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.as_messages(df))).collect()}
    told = lambda c: (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256)
    assert told(1) == (3, sha("\nx\nuser\n\nuser\n\n"), 0, sha(""))
    assert told(2) == (1, sha("assistant\n\n"), 0, sha(""))
    assert told(None) == (2, sha(f"assistant\n{'é' * 5}\ntool\n[INST]\n"), 5, sha("é" * 5))
    assert told(3) == (2, sha(f"assistant\na\nassistant\n{'b' * 300_000}\n"), 300_001, sha("a" + "b" * 300_000))
    assert chat.read_back(chat.format_turns(chat.as_messages(df.limit(0)))).count() == 0


def test_typed_parts_from_json(spark):
    content = '[{"type":"text","text":"look: </s>"},{"type":"image","ref":"s3://b/i.png","width":56,"height":29},{"type":"audio","ref":"u","seconds":2.5},{"type":"text","text":" end"}]'
    rows = [(1, 0, "user", content), (1, 1, "assistant", "[1, 2]"), (1, 2, "assistant", '[{"no": "type"}]'), (1, 3, "assistant", "plain"), (1, 4, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string").withColumn("parts", chat.json_parts(F.col("content")))
    out = chat.format_turns(df).orderBy("turn").collect()
    assert out[0].segment == "[INST]look: <\\/s>[image:0][audio:1] end[/INST]"
    assert [tuple(a) for a in out[0].attachments] == [(0, "image", "s3://b/i.png", 4), (1, "audio", "u", 63)] and out[0].expanded == 67 and out[0].loss == []
    assert [r.segment for r in out[1:]] == ["[1, 2]</s>", '[{"no": "type"}]</s>', "plain</s>", "[INST][/INST]"]
    assert [tuple(s) for s in out[3].loss] == [(0, 5)]
