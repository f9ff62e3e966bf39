"""Exact n-gram Jaccard join and its classes (operator 4).

Equal shingle sets are one class from the start. A prefix filter over globally rare-first ordered
shingles says which sets can link at all; sets that share a prefix shingle meet in a tile. Tiles are
banded by set size: a set's hashed bitmap has a length that follows its size, and within a tile only sizes
that the threshold admits are compared. Each bit in which two bitmaps differ is a shingle that the sets
don't share, so bit counts bound the overlap from above. What passes is checked by intersecting the
exact sorted arrays.

A key that very many sets share is mostly one template's near copies. Such sets are first compared with a few pivots of their key, exactly;
those that a pivot links are one component, and pairs inside it are never looked at: the key's tiles hold the pairs of the other sets, and of
those with the component.

A tile of m near copies has m^2 links. So tiles give only a spanning forest of what passes the bound, best
first; these edges are checked exactly and joined to components. Sets that passing pairs connect and
that still lie in several components are then read again, once each with their exact arrays, and every pair
of two components that passes is checked. Links inside a component change nothing, so nothing is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, in_bloom, mix
from .common import components, map_arrow, pick, save, texts_of
from .words import blocks, hash_words, roll

WORDS = 4
PERCENT = 85
#: A shingle in this share of the documents of a task is reported as frequent; it goes last in the order.
FREQUENT = 0.001
#: Rows of a tile; a larger group becomes tiles for pairs of its blocks.
TILE_ROWS = 2048
#: Sets that share a key, from which pivots are tried, and pivots for each key, one after the other.
PIVOT_ROWS, PIVOTS = 2048, 3
#: Sets of a unit that are compared exactly in one tile; a larger unit becomes tiles for all pairs of its blocks.
UNIT_ROWS = 4096


def shingles(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles; of the whole sequence if there are fewer words."""
    for _, part in blocks(texts):
        h, counts = hash_words([t.lower() for t in part])
        ends = np.cumsum(counts)
        runs = roll(h, n) if len(h) >= n else None
        for end, k in zip(ends.tolist(), counts.tolist()):
            if k == 0:
                yield np.zeros(0, np.uint64)
            elif k < n:
                yield roll(h[end - k : end], k)
            else:
                yield np.unique(runs[end - k : end - n + 1])


def set_digest(s: np.ndarray) -> bytes:
    """Tells equal shingle sets."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def number_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def frequent_shingles(docs: DataFrame, n: int) -> dict[int, int]:
    """Shingles that many documents hold, with their counts: at most (mean set size / FREQUENT) of them.

    Only the order of the prefix filter depends on it; any order gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0

        def flush() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(8, FREQUENT * count)
            return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(times[often])], ["s", "n"])

        for batch in batches:
            for s in shingles(texts_of(batch), n):
                held.append(s)
                size += len(s)
                count += 1
                if size > 4_000_000:
                    yield flush()
                    held, size, count = [], 0, 0
        if held:
            yield flush()

    total = docs.count()
    rows = map_arrow(docs, run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, FREQUENT * total)).collect()
    return {r["s"]: r["n"] for r in rows}


def bitmap(s: np.ndarray, bits: int = 0) -> bytes:
    """Hashed bits: a power of two of them, by default at least the set's size, 512 at least. Unrelated sets then differ in three
    times as many bits as two linked sets may."""
    bits = bits or max(512, 1 << (len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(s) >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the length: the upper half laid over the lower."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def features(docs: DataFrame, n: int, percent: int, frequent: dict[int, int]) -> DataFrame:
    """(doc_id, tk, n_shingles, sig, rep, prefix, bits) of every document; sig tells equal sets, rep is its first half as a number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    often = np.array(sorted(x % 2**64 for x in frequent), np.uint64)
    times = np.array([frequent[int(x) if x < 2**63 else int(x) - 2**64] for x in often.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sig, rep, prefix, bits = [], [], [], [], []
            for s in shingles(texts_of(batch), n):
                size.append(len(s))
                if not len(s):
                    sig.append(None)
                    rep.append(None)
                    prefix.append([])
                    bits.append(None)
                    continue
                p = len(s) - -(-percent * len(s) // 100) + 1
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    weight = np.where(often[at] == s, times[at], 0)
                    order = np.lexsort((s, weight)) if weight.any() else slice(None)
                    head = s[order][:p]
                else:
                    head = s[:p]
                sig.append(set_digest(s))
                rep.append(number_of(sig[-1]))
                prefix.append(head.view(np.int64))
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(rep, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "tk", "n_shingles", "sig", "rep", "prefix", "bits"])

    return map_arrow(docs, run, f"doc_id {kind}, tk long, n_shingles long, sig binary, rep long, prefix array<long>, bits binary")


def passing(rep: np.ndarray, size: np.ndarray, bits: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, margin) of a tile's rows whose bit counts admit a link, a few thousand at a time.

    margin orders pairs by the bound: the overlap it allows less the overlap that a link needs.
    """
    width = np.array([len(b) for b in bits])
    for w in np.unique(width):
        own, twice = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        m = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), -1)
        if len(twice):
            m = np.concatenate((m, folded(np.frombuffer(b"".join(bits[i] for i in twice), np.uint64).reshape(len(twice), -1))))
        row = np.concatenate((own, twice))
        n = size[row]
        order = np.argsort(n, kind="stable")
        m, row, n, base = m[order], row[order], n[order], (order < len(own))
        last = np.searchsorted(n, 100 * n // percent, side="right")
        for i in range(len(row)):
            e = int(last[i])
            if e <= i + 1:
                continue
            differ = np.bitwise_count(m[i + 1 : e] ^ m[i]).sum(1, dtype=np.int64)
            both = n[i + 1 : e] + n[i]
            margin = (100 + percent) * ((both - differ) // 2) - percent * both
            good = np.flatnonzero((margin >= 0) & (base[i + 1 : e] | base[i]))
            if len(good):
                yield np.full(len(good), row[i]), row[i + 1 + good], margin[good] / both[good]


def find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def in_tiles(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Tiles of more than one row of batches sorted by (tile, side), as (tile, rows). Of a tile for two blocks both must be there:
    the pairs inside one block belong to its own tile."""
    tile, held = None, []
    good = lambda: len(held) > 1 and not (held[0][0] < 0 and held[0][0] == held[-1][0])
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", *columns))):
            if row[0] != tile:
                if good():
                    yield tile, held
                tile, held = row[0], []
            held.append(row[1:])
    if good():
        yield tile, held


def rows_of(kind: str, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, types[kind] if n in ("a", "b") else pa.int64()) for c, n in zip(columns, names)], names)


def tile_forests(tiles: DataFrame, percent: int) -> DataFrame:
    """(tile, members, a, side_a, b, side_b): a spanning forest of the passing pairs of each tile, the pairs with the largest bound
    first. `tile` is told anew for each tree and members is its size: no pair of two trees passes, so each can be looked at by itself."""
    kind = tiles.schema["rep"].dataType.simpleString()

    def forest(tile: int, rows: list[tuple]) -> Iterator[tuple]:
        side, rep, size, bits = zip(*rows)
        if len(rep) == 2:
            (x, y), (p, q) = size, sorted(bits, key=len)
            if percent * max(x, y) <= 100 * min(x, y):
                if len(q) == 2 * len(p):
                    q = (int.from_bytes(q[: len(p)], "little") | int.from_bytes(q[len(p) :], "little")).to_bytes(len(p), "little")
                differ = (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count()
                if (100 + percent) * ((x + y - differ) // 2) >= percent * (x + y):
                    yield tile, 2, min(rep), 0, max(rep), 0
            return
        found = list(passing(np.array(rep), np.array(size, np.int64), list(bits), percent))
        if not found:
            return
        i, j, g = (np.concatenate(x) for x in zip(*found))
        if side[0] != side[-1]:
            s = np.array(side)
            keep = s[i] != s[j]
            i, j, g = i[keep], j[keep], g[keep]
        parent, edges = list(range(len(rep))), []
        best = np.argsort(-g, kind="stable")
        for x, y in zip(i[best].tolist(), j[best].tolist()):
            if (p := find(parent, x)) != (q := find(parent, y)):
                parent[p] = q
                edges.append((x, y) if rep[x] < rep[y] else (y, x))
        members, names = {}, {}
        for x, _ in edges:
            r = find(parent, x)
            members[r] = members.get(r, 1) + 1
            names.setdefault(r, int.from_bytes(hashlib.blake2b(f"{tile} {rep[r]}".encode(), digest_size=8).digest(), "little", signed=True))
        for x, y in edges:
            r = find(parent, x)
            yield names[r], members[r], rep[x], side[x], rep[y], side[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = ["tile", "members", "a", "side_a", "b", "side_b"]
        for tile, rows in in_tiles(batches, ("rep", "n_shingles", "bits")):
            out += forest(tile, rows)
            if len(out) > 20_000:
                yield rows_of(kind, out, names)
                out = []
        if out:
            yield rows_of(kind, out, names)

    return map_arrow(tiles, run, f"tile long, members long, a {kind}, side_a long, b {kind}, side_b long")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted arrays."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = overlap(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of each tile's rows, as far as they link at all. Pairs inside a component, of sizes too
    far apart or with too many different bits are passed over; all others are checked exactly."""
    kind = tiles.schema["rep"].dataType.simpleString()

    def links(rows: list[tuple]) -> Iterator[tuple]:
        rows = sorted(rows, key=lambda r: len(r[3]))
        side, rep, comp, raw = zip(*rows)
        sets = [np.frombuffer(s, np.uint64) for s in raw]
        n, side = np.array([len(s) for s in sets]), np.array(side)
        label = np.unique(np.array(comp), return_inverse=True)[1]
        width = 1 << (8 * int(n.max()) - 1).bit_length()
        m = np.stack([np.frombuffer(bitmap(s, max(512, width)), np.uint64) for s in sets])
        last = np.searchsorted(n, 100 * n // percent, side="right")
        for i in range(len(sets)):
            e = int(last[i])
            j = i + 1 + np.flatnonzero((label[i + 1 : e] != label[i]) & ((side[i + 1 : e] != side[i]) | (side[i] == 0)))
            if not len(j):
                continue
            both = n[j] + n[i]
            differ = np.bitwise_count(m[j] ^ m[i]).sum(1, dtype=np.int64)
            for k in j[(100 + percent) * ((both - differ) // 2) >= percent * both].tolist():
                if label[k] != label[i] and linked(sets[i], sets[k], percent):
                    label[label == label[k]] = label[i]
                    yield min(rep[i], rep[k]), max(rep[i], rep[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in in_tiles(batches, ("rep", "comp", "s")):
            out += links(rows)
        if out:
            yield rows_of(kind, out, ["a", "b"])

    return map_arrow(tiles, run, f"a {kind}, b {kind}").distinct()


def sorted_arrays(ends: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(rep, s): the sorted shingle hashes of the sets of `ends` (rep, doc_id, tk), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in shingles(texts_of(batch), n)], pa.binary())], ["rep", "s"])

    asked = ends.select("rep", F.col("doc_id").alias("end_id"), F.col("tk").alias("end_tk"))
    some = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("end_id")) & (F.col("tk") == F.col("end_tk"))).select("rep", "text")
    return map_arrow(some, run, "rep long, s binary").dropDuplicates(["rep"])


def check_edges(edges: DataFrame, exact: DataFrame, percent: int) -> DataFrame:
    """The edges that are links, by intersecting the sorted arrays of both ends."""
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.join(exact.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(exact.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs, links, f"a {kind}, b {kind}")


def held_keys(reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, rep) of the prefix keys that a fixed-size filter of `keys` lets through: all of them, and a few others."""
    table = reps.sparkSession.sparkContext.broadcast(bloom(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            key = prefix.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(prefix)), prefix.value_lengths().to_numpy(zero_copy_only=False))
            ok = in_bloom(table.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[ok]), batch.column("rep").take(pa.array(row[ok]))], ["key", "rep"])

    return map_arrow(reps.select("rep", "prefix"), run, "key long, rep long")


def pivot_links(hot: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """For the sets (key, rep) of hot keys: (key, rep, main), whether a set is in its key's largest component by links with pivots; and these
    links (a, b). A pivot is a set that no pivot of the key before has linked."""
    hot = save(hot)
    if not hot.limit(1).count():
        return hot.withColumn("main", F.lit(True)), hot.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    ends = hot.select("rep").distinct().join(reps.select("rep", "doc_id", "tk"), "rep")
    exact = save(sorted_arrays(ends, docs, n))
    left, links = hot, None
    for k in range(PIVOTS):
        pivots = left.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias("pivot"))
        asked = save(left.join(pivots, "key").where("rep <> pivot").select("key", "rep", F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")))
        found = save(check_edges(asked.select("a", "b").distinct(), exact, percent))
        links = found if links is None else links.union(found)
        left = save(asked.join(found, ["a", "b"], "left_anti").select("key", "rep"))
        if not left.limit(1).count():
            break
    links = save(links.distinct())
    labels = hot.join(components(links).select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    labels = save(labels)
    most = labels.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", "n").alias("most"))
    return save(labels.join(most, "key").select("key", "rep", (F.col("component") == F.col("most")).alias("main"))), links


def in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows (key, rep, main, ...) dealt into tiles: (tile, side, ...). A key of at most `size` rows is one tile, side 0; one whose rows all are in its
    main component is none. Of a larger one the rows
    outside its main component make blocks, with a tile for each block (side 0) and each two (sides -1 and -2); so does each of these
    blocks with each block of the main component, whose rows never meet each other."""
    outside = F.count(F.when(~F.col("main"), 1))
    sizes = rows.groupBy(key).agg(F.count("*").alias("all_rows"), F.greatest(F.lit(1), F.ceil(outside / size)).cast("int").alias("nb"), F.ceil((F.count("*") - outside) / size).cast("int").alias("na"), outside.alias("outside"))
    rows = rows.join(sizes, key)
    one = F.col("all_rows") <= size
    own = F.pmod(F.xxhash64("rep", F.lit(key)), F.when(F.col("main"), F.col("na")).otherwise(F.col("nb"))).cast("int")
    rows = rows.withColumn("own_block", F.when(one, F.lit(0)).otherwise(own))
    me = F.col("own_block")
    place = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.cast("int").alias("low"), high.cast("int").alias("high"), side.alias("side"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    side = lambda j: F.when(me == j, F.lit(0)).when(me < j, F.lit(-1)).otherwise(F.lit(-2))
    pairs = F.transform(upto("nb"), lambda j: place(0, F.least(me, j), F.greatest(me, j), side(j)))
    across = F.transform(upto("na"), lambda j: place(1, me, j, F.lit(-1)))
    inside = F.when(F.col("outside") > 0, F.transform(upto("nb"), lambda j: place(1, j, me, F.lit(-2)))).otherwise(F.array().cast("array<struct<kind:int,low:int,high:int,side:int>>"))
    alone = F.array(place(0, F.lit(0), F.lit(0), F.lit(0)))
    tiles = F.when(one & (F.col("outside") > 0), alone).when(F.col("main"), inside).otherwise(F.concat(pairs, across))
    return rows.withColumn("t", F.explode(tiles)).withColumn("tile", F.xxhash64(key, "t.kind", "t.low", "t.high")).withColumn("side", F.col("t.side")).drop("t", "own_block", "all_rows", "na", "nb", "outside")


def text_classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tk, n_shingles, component, component_id) of every row: tk is a hash of the text, component a number for the class (null for
    the empty set), component_id its smallest doc_id (null if it has none; a row of the empty set has its own)."""
    docs = pick(docs, "doc_id", "text").withColumn("tk", F.xxhash64("text"))
    frequent = frequent_shingles(docs, n)
    all_ = save(features(docs, n, percent, frequent))
    # a set is told by its digest, so rows of one doc_id with different texts, and rows without, link like all others
    some = all_.where("rep is not null")
    classes = save(some.groupBy("rep").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "tk")).alias("at")))
    chosen = classes.select(F.col("rep").alias("own"), F.col("at.doc_id").alias("own_id"), F.col("at.tk").alias("own_tk"))
    reps = save(some.join(chosen, (F.col("rep") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tk") == F.col("own_tk"))).select("rep", "doc_id", "tk", "n_shingles", "prefix", "bits").dropDuplicates(["rep"]))

    keys = reps.select(F.explode("prefix").alias("key"), "rep")
    counted = save(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    rows = save(held_keys(reps, counted).join(counted, "key"))
    # keys with the same members are one tile
    members = rows.groupBy("key", "c").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    shared = save(members.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"))
    rows = save(rows.join(shared, "key", "left_semi"))
    solved, near_pivots = pivot_links(rows.where(F.col("c") > PIVOT_ROWS).select("key", "rep"), reps, docs, n, percent)
    rows = rows.join(solved, ["key", "rep"], "left").select("key", "rep", F.coalesce("main", F.lit(False)).alias("main"))
    # bitmaps meet the narrow rows at the end only
    tiles = in_blocks(rows, "key", TILE_ROWS).select("tile", "side", "rep").join(reps.select("rep", "n_shingles", "bits"), "rep")
    dealt = lambda df: df.repartition("tile").sortWithinPartitions("tile", "side")
    forests = save(tile_forests(dealt(tiles), percent))
    pairs = save(forests.select("a", "b").distinct())
    joined = save(pairs.union(near_pivots).distinct())
    ends = joined.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(reps.select("rep", "doc_id", "tk"), "rep")
    exact = save(sorted_arrays(ends, docs, n))
    links = save(check_edges(pairs, exact, percent).union(near_pivots).distinct())
    parts = components(links)
    # Sets that passing pairs connect are one unit, so that each set is in one unit only. Units whose sets still lie in several
    # components are checked pair by pair, exactly, but for the pairs inside their largest component.
    units = components(joined).select(F.col("node").alias("rep"), F.col("component").alias("unit"))
    units = save(units.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "unit", F.coalesce("component", "rep").alias("comp")))
    mixed = units.groupBy("unit", "comp").agg(F.count("*").alias("n")).groupBy("unit").agg(F.count("*").alias("comps"), F.sum("n").alias("c"), F.max_by("comp", "n").alias("most"))
    mixed = save(mixed.where("comps > 1 and c > 2").select("unit", "most"))
    rest = units.join(mixed, "unit").withColumn("main", F.col("comp") == F.col("most"))
    rest = in_blocks(rest, "unit", UNIT_ROWS).select("tile", "side", "rep", "comp").join(exact, "rep")
    more = save(tile_links(dealt(rest), percent))
    if more.limit(1).count():
        parts = components(links.union(more))
    parts = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "first", F.coalesce("component", "rep").alias("component"))
    parts = save(parts)
    parts = save(parts.join(parts.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("rep", "component", "component_id"))
    found = all_.select("doc_id", "tk", "n_shingles", "rep").join(parts, "rep", "left")
    return found.select("doc_id", "tk", "n_shingles", "component", F.when(F.col("rep").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of their n-word shingle sets.

    Returns (doc_id, n_shingles, component_id) for every row: component_id is the smallest doc_id that
    links reach, the document's own included. Texts that are null or hold no word have the empty set and
    link with nothing; texts shorter than n words have their whole sequence as one shingle. Repeated rows
    stay and get the same class; rows of one doc_id with different texts each have their own. Rows without doc_id link too; where no row
    of a class has one, component_id is null. No rows give no rows. Other columns are not read. Shingles are compared by 64-bit hashes.
    """
    return text_classes(docs, n, percent).select("doc_id", "n_shingles", "component_id")
