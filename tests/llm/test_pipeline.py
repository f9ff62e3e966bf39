"""The corpus pipeline stage by stage, and main-text extraction."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfwright.llm import decontam, queries
from shelfwright.llm import html as pages_
from shelfwright.llm.common import save

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en"), (900002, "", "en"), (900003, "123 $$$", "en"), (900004, "write to a.b@example.com now", None), (900004, "write to a.b@example.com now", None)], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    before = {r.doc_id: r.text for r in docs.collect()}
    functions = dict(corpus_pipeline.STAGES)
    assert list(functions) == ["language", "near_duplicates", "decontaminate", "personal_data", "pack"]

    told = save(functions["language"](spark, docs, DATA))
    assert told.columns == docs.columns
    assert set(before) - {r.doc_id for r in told.collect()} == {900001, 900002, 900003}

    unique = save(functions["near_duplicates"](spark, told, DATA))
    rows = {r.doc_id: r.text for r in told.collect()}
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                    label[a], moved = label[b], True
    kept = [r.doc_id for r in unique.collect()]
    assert sorted(kept) == sorted(i for i in label if label[i] == i)

    clean = save(functions["decontaminate"](spark, unique, DATA))
    bad = {r.doc_id for r in decontam.contaminated(unique, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert bad and sorted(r.doc_id for r in clean.collect()) == sorted(set(kept) - bad)

    safe = save(functions["personal_data"](spark, clean, DATA))
    assert safe.columns == docs.columns and safe.count() == clean.count()
    texts = {r.doc_id: (r.text, r.n_chars) for r in safe.collect()}
    assert texts[900004][0] == "write to [EMAIL] now"
    assert not [t for t, _ in texts.values() if re.search(r"[\w.]+@[\w-]+\.\w", t)]
    assert all(n == len(t) for i, (t, n) in texts.items() if i < 900000)

    pieces = functions["pack"](spark, safe, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def test_near_duplicates_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()) == [1, 2, 3]


@pytest.fixture(scope="module")
def labeller(spark):
    return pages_.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_extraction_is_exact_on_unseen_pages(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id >= 250 and page_id % 5 = 0")
    got = {r.page_id: r.text for r in pages_.extract(pages, labeller).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"<(?!/?b>)[^>]*>", body)]
        assert got[r.page_id] == " ".join(p for p in parts if p)


def test_extraction_on_other_wrappers(spark, labeller):
    rng = np.random.default_rng(12)
    wrong = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id between 1000 and 1060").collect():
        found = pages_.blocks(r.html)
        text, labels = pages_.variant(found, [pages_.weak_label(p) for _, p, _ in found], rng)
        again = pages_.blocks(text)
        if len(again) == len(labels):
            y = labeller.label([pages_.vectors(again)])[0] >= 0.5
            wrong += int((y != np.array(labels, bool)).sum())
            total += len(labels)
    assert total > 500 and wrong <= 0.04 * total


def test_extraction_in_deep_markup(spark, labeller):
    """The outer wrapper counts, however many grid divs stand between it and the text."""
    deep = lambda tag, inner: f"<{tag}>" + '<div class="row gx-4 col-md-8 px-3">' * 6 + inner + "</div>" * 6 + f"</{tag.split()[0]}>"
    (_, one, _), (_, other, _) = (pages_.blocks(deep(tag, "<p>Same text.</p>"))[0] for tag in ('section class="comments"', "article"))
    assert (pages_.vectors([("Same text.", one, 0)]) != pages_.vectors([("Same text.", other, 0)])).any()
    wrong = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id between 1000 and 1060").collect():
        texts = [t for t, path, _ in pages_.blocks(r.html) if pages_.weak_label(path) == 1.0]
        paragraphs = "".join(f"<p>{html.escape(t)}</p>" for t in texts)
        page = deep("article", paragraphs) + deep('div class="sidebar"', "".join(f"<p>{html.escape(t)}</p>" for t in texts[:3]))
        y = labeller.label([pages_.vectors(pages_.blocks(page))])[0] >= 0.5
        want = np.arange(len(y)) < len(texts)
        wrong += int((y != want).sum())
        total += len(y)
    assert total > 300 and wrong <= 0.04 * total


def test_extraction_edges(spark, labeller):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no tags at all"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<" * 3000), (6, "u", "<div " + 'a="' * 2000), (7, "u", "<article><p>&lt;x&gt; &amp;amp; &#65;\n\n z</p><script>if (a < b) '</p>'</script></article>"), (7, "u", "<article></article>")]
    got = pages_.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1)}), labeller).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert "<x> &amp; A z" in {r.text for r in got if r.page_id == 7}
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages_.extract(none, pages_.fit(none)).collect() == []


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


def test_gradients_against_differences():
    """Back-propagation through both directions agrees with finite differences."""
    rng = np.random.default_rng(4)
    model = pages_.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages = [(rng.normal(size=(n, pages_.PATH_DIM + pages_.WORD_DIM + pages_.NUMBERS)).astype(np.float32), rng.integers(0, 2, n).astype(np.float32)) for n in (3, 5)]
    x, mask, target = pages_.padded(pages)

    def loss():
        y = np.clip(model.forward(x, mask)[0].astype(np.float64), 1e-12, 1 - 1e-12)
        return -(mask * (target * np.log(y) + (1 - target) * np.log(1 - y))).sum() / mask.sum()

    grad = model.gradients(x, mask, target)
    for name in model.p:
        flat = model.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 3):
            old = flat[k]
            flat[k] = old + 1e-4
            up = loss()
            flat[k] = old - 1e-4
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-4 - grad[name].reshape(-1)[k]) < 1e-3
