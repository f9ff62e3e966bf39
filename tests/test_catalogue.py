"""Semantics of the catalogue operators on small hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import text as T
from shelfwright.operators import brand, catalog, classify, policy, quality, tree
from shelfwright.sources import packs, pages, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [(None, ""), ("  ", ""), ("a 　b\n c ", "a b c")])
def test_clean_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(T.clean_text(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("raw, want", [("1,234,000원", 1234000), ("12", 0), (",,,", 0), ("1 234", 234), ("from 5,000 to 9,000", 5000), (None, 0)])
def test_price_num(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(T.price_num(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(
    "u, variant, want",
    [
        ("//h/x", "plain", "https://h/x"), ("/x", "plain", "http://b/x"), ("x", "plain", "http://b/x"), ("./x", "plain", "http://b/x"), ("a\\b", "plain", "http://b/a/b"), ("", "plain", ""),
        ("../x", "dots", "http://b/x"), ("http://https://h/x", "repair", "https://h/x"), ("x", "strict", "x"), ("http://h", "plain", "http://h"),
    ],
)
def test_abs_url(spark, u, variant, want):
    assert spark.createDataFrame([(u,)], "u string").select(T.abs_url(F.lit("http://b"), F.col("u"), variant)).first()[0] == want


def test_price_policies(spark):
    got = lambda li, sa, p, text="": tuple(spark.range(1).select(T.price_policy(F.lit(li), F.lit(sa), p, F.lit(text)).alias("x")).first()["x"])
    assert got(100, 80, "list_first") == (100, 100, 80, False)
    assert got(0, 80, "list_first") == (80, 0, 80, False)
    assert got(0, 0, "list_first") == (0, 0, 0, True)
    assert got(100, 100, "equal_is_none") == (100, 0, 100, False)
    assert got(50, 80, "inverted_is_none") == (80, 0, 80, False)
    assert got(0, 80, "phone_inquiry", "please call") == (0, 0, 0, True)
    assert got(90, 80, "phone_inquiry", "please call") == (90, 90, 0, False)


def test_lists_and_titles(spark):
    df = spark.createDataFrame([(["a/7/1.jpg", "", "data:x", "a/7/1.jpg", "b/77.png"], "7")], "xs array<string>, sid string")
    assert df.select(T.ordered_uniq(F.col("xs"))).first()[0] == ["a/7/1.jpg", "b/77.png"]
    assert df.select(T.own_images(F.col("xs"), F.col("sid"))).first()[0] == ["a/7/1.jpg", "a/7/1.jpg"]
    assert df.select(T.own_images(F.array(F.lit("b/77.png")), F.col("sid"))).first()[0] == ["b/77.png"]
    long = "[new] " + "word " * 12 + "- shop"
    assert one(spark, T.clean_title(F.col("s")), s=long) == ("word " * 12).strip()
    assert one(spark, T.clean_title(F.col("s")), s="[new] short - x") == "[new] short - x"
    assert one(spark, T.strip_suffixes(F.col("s"), [" Series", " Box"]), s="Matte Box Series") == "Matte"
    assert one(spark, T.strip_suffixes(F.col("s"), ["bc"]), s="abc") == "abc"
    assert one(spark, T.img_src(F.col("s")), s='<img alt="x" src="a.png"><IMG SRC=\'b.png\'>') == ["a.png", "b.png"]
    assert one(spark, T.unescape_all(F.col("s")), s="&eacute;&#x41;") == "éA"
    path = F.array(F.lit("Cat"), F.lit("ACME"), F.lit("Lens"))
    assert one(spark, T.path_after_brand(path, F.array(F.lit("acme")), F.col("s"), "etc"), s="c") == ["Lens"]
    assert one(spark, T.path_after_brand(path, F.array(F.lit("other")), F.col("s"), "etc"), s="c") == ["Cat", "ACME", "Lens"]
    assert one(spark, T.path_after_brand(F.array(F.lit("acme")), F.array(F.lit("ACME")), F.col("s"), "etc"), s="") == ["etc"]
    assert one(spark, T.format_price(F.lit(0), F.lit(12.5)), s="") == "$12.50"


RULES = [("Acme Pro ", "pro"), ("ACME", "acme"), ("B W", "bw")]
NAMES = ["Acme Pro 5", "AcmePro5", "ACME x", "[sale] ACME y", "[B W] [new] thing", "[acme pro x] z", "zzz", "", None, "[ACME]"]
WANT = ["pro", "pro", "acme", "acme", "bw", "pro", "_misc", "_misc", "_misc", "acme"]


def test_brands_both_forms(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id int, name string")
    table = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(RULES)], "priority int, prefix string, slug string")
    assert [r.x for r in df.select("id", brand.brand_fold(F.col("name"), RULES).alias("x")).orderBy("id").collect()] == WANT
    assert [r.slug for r in brand.resolve_brands(df, table).orderBy("id").collect()] == WANT


def test_classifier_both_forms(spark):
    rules = [("a", ["filter"]), ("b", ["lens c+", "case"]), ("c", ["filter case"])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Filter case", "LENS C+", "case x", "none", None])], "id int, name string")
    fold = {r.id: r.x for r in df.select("id", classify.first_match(F.col("name"), rules).alias("x")).collect()}
    joined = {r.id: r.x for r in classify.first_match_join(df, "name", classify.rule_table(spark, rules), "x").collect()}
    assert fold == joined == {0: "a", 1: "b", 2: "b", 3: None, 4: None}
    audit = {r.priority: (r.hits, r.first_hits) for r in classify.rule_audit(df, "name", classify.rule_table(spark, rules)).collect()}
    assert audit == {0: (1, 1), 1: (3, 2), 2: (1, 0)}
    t = lambda s: one(spark, classify.tstop(F.col("s"), ["zoom"], ["lens", "mm"], "z", "p"), s=s)
    assert (t("Cine 50mm T2.9"), t("T 1.5 zoom lens"), t("T2.9 cable"), t("렌즈T2.9 lens")) == ("p", "z", None, None)


def test_policy_order(spark):
    rows = [("x", "a", True), ("x", "t1", False), ("x", "t2", False), ("pin", "s3", False), ("pin", "t1", False), ("only", "dem", False), ("more", "dem", False), ("more", "q", False), ("_misc", "t1", False), ("_misc", "dem", False), ("_misc", "q", False), ("j", "t1", True), ("j", "q", False)]
    df = spark.createDataFrame(rows, "slug string, source string, junk boolean")
    kept = policy.with_policy(df, ["t1", "t2"], "dem", {"pin": "s3"}, junk=F.col("junk"))
    # a first-tier source that is only junk still removes the brand's other sources
    assert sorted((r.slug, r.source) for r in kept.collect()) == [("_misc", "q"), ("_misc", "t1"), ("more", "q"), ("only", "dem"), ("pin", "s3"), ("x", "t1"), ("x", "t2")]


def test_trees(spark):
    codes = spark.createDataFrame([("s", "001", "A"), ("s", "001002", ""), ("s", "001002003", "C"), ("s", "009", "Z")], "site string, code string, name string")
    got = {r.code: r.path for r in tree.ancestor_paths(codes, 3).collect()}
    assert got == {"001": ["A"], "001002": ["A"], "001002003": ["A", "C"], "009": ["Z"]}
    assert {r.code for r in tree.leaves(codes).collect()} == {"001002003", "009"}
    listed = spark.createDataFrame([("s", "1", "b", 1), ("s", "1", "a", 2), ("s", "1", "c", 2)], "site string, sid string, code string, depth int")
    assert tree.deepest_membership(listed).first()["code"] == "a"
    products = spark.createDataFrame([("1", "s", "1", "009", "old", ["old"]), ("2", "s", "2", "009", "old", ["old"]), ("3", "t", "3", "", "keep", ["keep"])], "id string, source string, source_id string, cate_no string, category string, cat_path array<string>")
    m = spark.createDataFrame([("s", "1", "001002003")], "site string, sid string, code string")
    once = tree.rebuild_paths(products, m, tree.ancestor_paths(codes, 3))
    assert {r.id: (r.cat_path, r.category, r.path_changed) for r in once.collect()} == {"1": (["A", "C"], "C", True), "2": (["Z"], "Z", True), "3": (["keep"], "keep", False)}
    again = tree.rebuild_paths(once.drop("path_found", "path_changed"), m, tree.ancestor_paths(codes, 3))
    assert not [r for r in again.collect() if r.path_changed]


def test_packs_round_trip(spark, tmp_path):
    out = str(tmp_path / "out")
    tmp_path = tmp_path / "in"
    tmp_path.mkdir()
    item = {"id": "s-1", "source": "s", "name": "n", "brand_slug": "", "price": 5, "images": {"thumb": "t", "main": ["m"], "detail": []}}
    (tmp_path / "b.json").write_text(json.dumps({"brand": "B", "brand_slug": "", "products": {"s-1": item, "s-2": {"name": "x", "brand_slug": "own"}}}))
    (tmp_path / "a.json").write_text(json.dumps({"brand": "A", "brand_slug": "aa", "products": {}}))
    (tmp_path / "_index.json").write_text(json.dumps({"products": {"s-9": item}}))
    rows = packs.read_packs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.id, r.brand_slug, r.pos, r.file_ord) for r in rows] == [("s-1", "b", 0, 2), ("s-2", "own", 1, 2)]
    sinks.write_packs(packs.read_packs(spark, str(tmp_path)), out)
    only = packs.read_packs(spark, str(tmp_path)).where("brand_slug = 'own'").withColumn("name", F.lit("new"))
    sinks.write_packs(only, out)
    assert {r.brand_slug: r.name for r in spark.read.parquet(out).collect()} == {"b": "n", "own": "new"}


def test_checkpoints_and_walks(spark, tmp_path):
    (tmp_path / "k_done.json").write_text('["01","02"]')
    (tmp_path / "a_done.json").write_text('{"cats":["1"],"ids":["7","8"]}')
    got = {(r.site, r.kind, r.key) for r in packs.read_checkpoints(spark, f"{tmp_path}/*_done.json").collect()}
    assert got == {("k", "cat", "01"), ("k", "cat", "02"), ("a", "cat", "1"), ("a", "id", "7"), ("a", "id", "8")}
    (tmp_path / "catwalk_x.json").write_text('{"membership":{"1":"c"},"paths":{"c":["A","B"]}}')
    m, p = packs.read_walks(spark, f"{tmp_path}/catwalk_*.json")
    assert m.collect() == [("x", "1", "c")] and p.collect() == [("x", "c", ["A", "B"])]
    maps = sinks.walk_maps(m, p).first()
    assert maps.membership == {"1": "c"} and maps.paths == {"c": ["A", "B"]}
    assert packs.read_dictionary(spark, f"{tmp_path}/missing.json", "a string").collect() == []
    (tmp_path / "names.json").write_text('{"a":"x","b":"y"}')
    assert {tuple(r) for r in packs.code_names(spark, f"{tmp_path}/names.json").collect()} == {("a", "x"), ("b", "y")}
    sinks.write_checkpoint(m.select("sid"), f"{tmp_path}/ck")
    assert spark.read.json(f"{tmp_path}/ck").count() == 1


def test_item_list_and_pages(spark):
    page = lambda n, ids: (n, "L", json.dumps({"itemList": [{"itemId": i, "itemNm": f"n{i}", "brndNm": "B", "spprc": "1,000", "slprc": "1,200", "prcInqYn": "N"} for i in ids], "paginationInfo": {"totalPageCount": 2}}))
    df = spark.createDataFrame([page(1, "ab"), page(2, "bc"), page(3, "z")], "page_no int, listing string, value string")
    assert sorted((r.itemId, r.name, r.price, r.category) for r in packs.read_item_list(df).collect()) == [(i, f"B n{i}", 1200, "L") for i in "abc"]
    p = spark.createDataFrame([("s", "c", 1), ("s", "c", 2), ("s", "c", 3)], "site string, cat string, page_no int")
    items = spark.createDataFrame([("s", "c", 1, 0, "1", "u"), ("s", "c", 3, 0, "9", "u")], "site string, cat string, page_no int, pos int, sid string, url string")
    assert [r.page_no for r in pages.new_per_page(p, items).collect()] == [1]
    html = spark.createDataFrame([("s", "c", 1, '<li><a href="/product/x/12">A <b>b</b></a><a href="/other">o</a><a href="/product/y/12">again</a></li>')], "site string, cat string, page_no int, html string")
    rules = spark.createDataFrame([("s", "http://b", "/product/[^/]+/([0-9]+)")], "site string, base string, sid_pattern string")
    assert [(r.sid, r.url) for r in pages.extract_listing(html, rules).collect()] == [("12", "http://b/product/x/12")]
    rows = spark.createDataFrame([("i", 0, "price", "0"), ("i", 1, "price", "2,000"), ("i", 2, "price", "9,000"), ("i", 3, "x", "1,000")], "id string, pos int, label string, value string")
    assert pages.labelled_value(rows, ("price",)).collect() == [("i", 2000)]
    hook = pages.parse_with(html.select("site"), lambda it: (f.assign(n=1) for f in it), "site string, n long")
    assert hook.collect() == [("s", 1)]


def test_feed_edges(spark, tmp_path):
    rows = [("n", "z", "1", "t1", "a", 0, 5.0, "i"), ("n", "z", "2", "t1", "a", 3, 0.0, ""), ("n", "_misc", "3", "t1", "a", 9, 0.0, "j"), ("m", "y", "4", "t0", "b", 1, 0.0, "k")]
    cards = spark.createDataFrame(rows, "n string, s string, id string, c string, sub string, p int, usd double, t string").withColumn("b", F.col("s"))
    order = catalog.catalogue_order(["t0", "t1"])
    assert [r.id for r in cards.orderBy(*order).collect()] == ["4", "1", "2", "3"]
    page, facets = catalog.facet_query(cards, order, category="t1")
    assert [r.header for r in page.orderBy("pos").collect()] == [True, False, False] and facets.where("level = 0").first()["n"] == 3
    assert catalog.facet_query(cards, order, category="none")[0].collect() == []
    sinks.write_feed(cards, f"{tmp_path}/feed", order)
    assert json.loads(spark.read.text(f"{tmp_path}/feed").first()["value"])["id"] in "1234"
    names = brand.display_names(spark.createDataFrame([("a", "X", 3), ("a", "Y", 1), ("_misc", "q", 2)], "s string, brand string, o int"), "s", "brand", ["o"])
    assert {r.slug: r.display for r in names.collect()} == {"a": "Y", "_misc": "etc"}
    t = spark.createDataFrame([("zebra", "1"), ("가나", "2"), ("Apfel", "3")], "name string, slug string")
    assert [r.slug for r in catalog.tiles(t, "name").collect()] == ["2", "3", "1"]


def test_repairs(spark, tmp_path):
    schema = "id string, brand_slug string, name string, source string, cat_path array<string>, images struct<thumb:string,main:array<string>,detail:array<string>>"
    df = spark.createDataFrame([("1", "_misc", "n", "s", ["a"], ("", [], ["m/_misc/d", "e"])), ("2", "b", "n", "s", None, ("t", ["m"], []))], schema)
    fixed = quality.promote_thumbs(df)
    first = fixed.where("id = '1'").first()
    assert first.promoted and first.images.thumb == "m/_misc/d" and first.images.main == ["m/_misc/d"]
    assert not quality.promote_thumbs(fixed.drop("promoted")).where("promoted").collect()
    moved, report = quality.reclassify(fixed.drop("promoted"), spark.createDataFrame([("1", "acme")], "id string, slug string"))
    assert moved.where("id = '1'").first().images.thumb == "m/acme/d" and {tuple(r) for r in report.collect()} == {(True, 1)}
    path = str(tmp_path / "t")
    report = sinks.apply_changes(df, moved.drop("moved"), ["id"], ["images"], path, apply=False)
    assert [tuple(r) for r in report.collect()] == [("acme", 1)] and not (tmp_path / "t").exists()
    sinks.apply_changes(df, moved.drop("moved"), ["id"], ["images"], path, apply=True)
    assert spark.read.parquet(path).count() == 1
    sinks.archive_removed(df, "junk", "2024-01-01", str(tmp_path / "arch"))
    assert spark.read.json(str(tmp_path / "arch")).count() == 2
    sinks.write_product_docs(df.select("id", "brand_slug"), str(tmp_path / "docs"), limit=1)
    assert spark.read.json(str(tmp_path / "docs")).count() == 1
    assert policy.block_url_rows(spark.createDataFrame([("a",), ("b",)], "url string"), spark.createDataFrame([("b",)], "u string")).collect() == [("a",)]


def test_every_reference(spark):
    """All named references, with and without ';', and numbers of every kind, against the standard library."""
    import html as library
    from html.entities import html5

    texts = [f"a &{n} b" for n in html5] + [f"&{n.rstrip(';')}x;" for n in list(html5)[:400]] + ["", "no reference", "& &; &#; &#x; &nope; &&amp;amp;", "&amplt; &notit; &notin; &#38;#38;", None]
    texts += [f"&#{n};&#x{n:x} " for n in (0, 1, 9, 13, 38, 65, 127, 128, 129, 150, 159, 160, 233, 8364, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**25)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", T.unescape(F.col("s")).alias("u"), T.unescape_all(F.col("s")).alias("v")).collect()
    for r in got:
        want = None if texts[r.i] is None else library.unescape(texts[r.i])
        assert r.u == want and r.v == want, texts[r.i]
    assert one(spark, T.img_src(F.col("s")), s="<img src=a.png alt=x><img class=y src='b.png?x=1&amp;y=2'><img data-x src = \"c d.png\">") == ["a.png", "b.png?x=1&y=2", "c d.png"]
    assert one(spark, T.strip_suffixes(F.col("s"), [" x"]), s="ab  x") == "ab"
    assert one(spark, T.strip_first_word_in(F.col("s"), ["c++", "a.b"]), s="C++ book") == "book" and one(spark, T.strip_first_word_in(F.col("s"), ["a.b"]), s="axb book") == "axb book"


def test_parent_paths_and_places(spark):
    nodes = [(1, "r", 0), (2, "a", 1), (3, "b", 2), (4, "c", 3), (5, "d", 4), (6, "lost", 77), (7, "x", 8), (8, "y", 7), (9, "z", 8)]
    got = {r.id: r.path for r in tree.parent_paths(spark.createDataFrame(nodes, "id long, name string, parent long")).collect()}
    assert got == {1: ["r"], 2: ["r", "a"], 3: ["r", "a", "b"], 4: ["r", "a", "b", "c"], 5: ["r", "a", "b", "c", "d"], 6: ["lost"], 7: None, 8: None, 9: None}
    chain = spark.range(1, 300).select("id", F.col("id").cast("string").alias("name"), (F.col("id") - 1).alias("parent"))
    assert {r.id: len(r.path) for r in tree.parent_paths(chain).collect()} == {i: i for i in range(1, 300)}
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.lit("big")).otherwise(F.concat(F.lit("l"), (F.col("id") % 3).cast("string"))).alias("l"), (F.col("id") * 37 % 1000).alias("o"), (F.col("id") % 5 == 0).cast("string").alias("h"))
    placed = catalog.paged_by(rows, ["l"], [F.col("o")], "h", 60).toPandas()
    for _, part in placed.groupby("l"):
        part = part.sort_values("pos")
        assert part["pos"].tolist() == list(range(1, len(part) + 1)) and part["o"].is_monotonic_increasing
        assert part["header"].tolist() == [True, *(a != b for a, b in zip(part["h"], part["h"][1:]))]
        assert part["remaining"].tolist() == list(range(len(part) - 1, -1, -1)) and part["page"].tolist() == [k // 60 for k in range(len(part))]


def test_walks_in_parts(spark):
    m = spark.range(1000).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("sid"), (F.col("id") % 9).cast("string").alias("code"))
    maps = sinks.walk_maps(m, m.select("site", "code", F.array("code").alias("path")).distinct(), 100)
    assert maps.count() == 10 and maps.select(F.max(F.size("membership"))).first()[0] < 200
    back, paths = packs.walk_tables(maps)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect())) and paths.count() == 9
