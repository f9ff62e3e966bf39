"""Queries on odd rows of the given tables, against their SQL twins."""

from pathlib import Path

import duckdb

from shelfwright.plans import registry
from shelfwright.sources import staging


def both(spark, folder, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)


def cut_pages(spark, folder):
    """Pages with references that are cut, unknown, or escaped twice."""
    odd = ["a &&&amp", "b &lt", "c &amp;lt; &quot;&amp;amp", "d &copy; &#65;&lt;i&gt;", "&", "e &amp;amp;"]
    rows = [(i, f"https://h{i}.example/{'ab'[i % 2]}/{i}", f"<title>{x}</title><nav><li><a href=\"/x{i}\">{x}</a></nav><h1>{x}</h1><p>1,200") for i, x in enumerate(odd * 2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")


def test_breadcrumbs_with_cut_references(spark, tmp_path):
    cut_pages(spark, tmp_path)
    for name in ("breadcrumbs", "page_links", "category_menu"):
        got, want = both(spark, tmp_path, name, ["pages"])
        assert got == want and got, name


def test_page_products_with_cut_references(spark, tmp_path):
    cut_pages(spark, tmp_path)
    got, want = both(spark, tmp_path, "page_products", ["pages"])
    assert got == want and got


def test_price_policies_at_half_cents(spark, tmp_path):
    """Prices whose discounted form lies at x.995, where the shortest decimal and the double itself are rounded to different numbers."""
    rows = [(i, 5, 1.0, price, off) for i, (price, off) in enumerate([(52283.5, 0.03), (11537.75, 0.02), (66387.75, 0.02)])]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = both(spark, tmp_path, "price_policies", ["lineitem"])
    assert got == want and got


def test_packs_hold_hundreds_of_products(spark, tmp_path):
    """Packs, thus files, are few: their number is what reading costs (F10)."""
    rows = [(i, f"n {i}", f"B#{i % 5}", "SMALL", i % 50, 900.0 + i) for i in range(3_000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got, want = both(spark, tmp_path, "brand_packs", ["part"])
    assert got == want and len(got) == 3_000
    assert len(list(Path(staging._made[-1].removeprefix("file://")).glob("*.json"))) == 5
