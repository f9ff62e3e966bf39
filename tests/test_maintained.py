"""Counts from deltas, pages from an index, changes from digests: what they give, and what they leave unread."""

import random

from pyspark.sql import functions as F

from shelfwright.operators import catalog, maintained


def card(rng, i):
    return (i, rng.choice("xyz"), rng.choice(["a", "b", None]), rng.choice("pq"))


def test_counts_after_batches_and_repeated_batches(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "counts")
    schema, state = "id int, c string, s string, sub string", {}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    for n in range(5):
        before = dict(state)
        for i in rng.sample(range(200), 40):
            if rng.random() < 0.3:
                state.pop(i, None)
            else:
                state[i] = card(rng, i)
        deltas = maintained.facet_deltas(maintained.signed(frame(before.values()), frame(state.values()), ["id"], ["c", "s", "sub"]))
        touched = maintained.apply_deltas(spark, path, deltas, n, buckets=16)
        assert touched
        if n == 2:  # a crash after the batch was written: it is done again, and changes nothing
            assert maintained.apply_deltas(spark, path, deltas, n, buckets=16) == []
        got = {tuple(r) for r in maintained.counts(spark, path).collect()}
        assert got == {tuple(r) for r in catalog.facet_counts(frame(state.values())).collect()}


def test_untouched_buckets_are_not_written(spark, tmp_path):
    path = str(tmp_path / "counts")
    rows = spark.createDataFrame([(f"c{i}", "s", "u", 1) for i in range(50)], "c string, s string, sub string, sign int")
    maintained.apply_deltas(spark, path, maintained.facet_deltas(rows), 0)
    files = lambda: {f.relative_to(tmp_path): f.stat().st_mtime_ns for f in (tmp_path / "counts").rglob("*.parquet")}
    before = files()
    one = spark.createDataFrame([("c1", "s", "u", -1)], "c string, s string, sub string, sign int")
    touched = maintained.apply_deltas(spark, path, maintained.facet_deltas(one), 1)
    kept = [f for f in files() if f in before]
    assert len(touched) <= 4 and all(f"bucket={b}/" not in str(f) for f in kept for b in touched) and len(kept) > 20
    assert maintained.counts(spark, path).where("level = 1 and category = 'c1'").count() == 0


def test_sketches_merge(spark):
    cards = spark.range(60_000).select((F.col("id") % 3).alias("c"), F.concat(F.lit("b"), (F.col("id") % 20_000).cast("string")).alias("s"))
    parts = [maintained.brand_sketches(cards.where(F.col("c").isNotNull() & (F.hash("s") % 3 == k))) for k in (-2, -1, 0, 1, 2)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    exact = {r.c: r.brands for r in catalog.brands_per_category(cards).collect()}
    for r in maintained.sketched_counts(maintained.merged_sketches(merged)).collect():
        assert abs(r.brands - exact[r.c]) <= r.error <= 0.06 * exact[r.c]


def test_pages_read_few_files(spark, tmp_path):
    for n in (500, 5_000):
        cards = spark.range(n).select(F.when(F.col("id") % 5 == 0, F.lit("y")).otherwise(F.lit("x")).alias("c"), F.col("id"), F.floor(F.col("id") / 7).alias("sub"))
        path, order = str(tmp_path / f"p{n}"), [F.desc("sub"), F.col("id")]
        maintained.write_pages(cards, ["c"], order, "sub", path, 20)
        all_rows = {(r.c, r.pos): tuple(r) for r in catalog.paged_by(cards, ["c"], order, "sub", 20).collect()}
        for c, page in (("x", 0), ("x", 7), ("y", 2), ("y", 10_000)):
            got = maintained.read_page(spark, path, {"c": c}, page, 20)
            assert len(got.inputFiles()) <= 2
            assert sorted(tuple(r) for r in got.collect()) == sorted(t for (k, pos), t in all_rows.items() if k == c and (pos - 1) // 20 == page)


def test_changes_by_digests(spark, tmp_path):
    old = [(i, f"v{i % 50}", None if i % 3 else i) for i in range(3_000)]
    new = [r for r in old if r[0] not in (5, 6)]
    new = [(i, "other", v) if i in (100, 101) else (i, s, None) if i == 300 else (i, s, v) for i, s, v in new] + [(9_001, "v", None)]
    for name, rows in (("old", old), ("new", new)):
        maintained.write_digested(spark.createDataFrame(rows, "id int, s string, v int"), ["id"], ["s", "v"], str(tmp_path / name), 128, 8)
    got = maintained.changed_rows(spark, str(tmp_path / "old"), str(tmp_path / "new"), ["id"], ["s", "v"])
    assert sorted(tuple(r) for r in got.collect()) == [(100, "other", 100 if 100 % 3 == 0 else None), (101, "other", None), (300, "v0", None), (9_001, "v", None)]
    assert maintained.changed_buckets(spark, str(tmp_path / "old"), str(tmp_path / "new")).count() <= 6
    assert maintained.changed_buckets(spark, str(tmp_path / "old"), str(tmp_path / "old")).count() == 0


def test_stored_keys_are_pruned(spark, monkeypatch):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (70_001, "d")], "k long, v string")
    stored = spark.range(70_000).select(F.col("id").alias("k"))
    for most in (1_000_000, 1):
        monkeypatch.setattr(maintained, "PRUNE_KEYS", most)
        assert sorted(r.v for r in maintained.without_stored(items, stored.where("k <> 2"), ["k"]).collect()) == ["b", "c", "d"]


def test_broken_pack_files(spark, tmp_path):
    """A folder of packs of which some files are cut off, empty or something else."""
    from shelfwright.sources import packs

    texts = {"a": '{"brand": "A", "brand_slug": "a", "products": {"1": {"id": "1"}}}', "b": '{"brand": "B", "products": {"1"', "c": " \n", "d": "[1, 2]", "e": "<html>", "f": "{}"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    good, bad = packs.split_packs(spark, str(tmp_path))
    name = lambda r: r.file.rsplit("/", 1)[1][0]
    assert {name(r) for r in good.collect()} == {"a", "f"}
    assert {name(r): r.reason for r in bad.collect()} == {"b": "no JSON", "c": "empty", "d": "another shape", "e": "no JSON"}
