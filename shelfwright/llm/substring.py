"""Removal of passages that repeat across documents (operator 1).

Every window of `n` words belongs to the segment around its minimiser (the smallest hash of a few words in a
row inside it), so equal windows of two documents lie in segments with the same key. Keys met in one
document only are put aside: a fixed-size filter of the others goes to all tasks. What is left is cut into
shards by key. A shard is indexed as a compressed FM-index: the Burrows-Wheeler transform of its segments, read backwards,
in a wavelet matrix of packed bits with sampled ranks. The segments are streamed through it: backward search, a word more with each step,
gives their matching statistics - for each place the longest run of words from there that stands elsewhere too. Where they reach the window's length the
rows of the index tell the smallest document that holds it, and such places in a row are the intervals that are reported.
Equal segments are counted once, with their smallest document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bloom, in_bloom
from .common import map_arrow, pick, save, texts_of
from .words import blocks, hash_words, roll

WINDOW = 13
#: Words that a minimiser looks at.
GRAM = 5
#: Segments in one index.
SHARD_SEGMENTS = 20_000
#: Bytes of a word's hash that stand for it in an index.
SYMBOL = 5
#: Distinct segments that a task puts together before it passes them on.
TASK_SEGMENTS = 200_000
#: A key met more often is cut into single windows, so that no key brings an index more than so many segments. Such keys are told by a
#: filter of fixed size; another key that it lets through is cut everywhere too.
HOT = 2_000


def segments(texts: list[bytes], n: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of many texts: (row, first window, windows, key, words) - words: the hashes of all texts' words in a row,
    and starts: where each row's begin."""
    h, sizes = hash_words(texts)
    starts = np.cumsum(sizes) - sizes
    total = len(h)
    if total < n:
        none = np.zeros(0, np.int64)
        return none, none, none, none, h, starts
    span = n - GRAM + 1
    g = roll(h, GRAM)
    low = (g & ~np.uint64(15))[: total - n + 1].copy()
    for i in range(1, span):
        np.minimum(low, (g[i : total - n + 1 + i] & ~np.uint64(15)) | np.uint64(i), out=low)
    row = np.repeat(np.arange(len(texts)), sizes)[: total - n + 1]
    at = np.arange(total - n + 1) + (low & np.uint64(15)).astype(np.int64)
    good = (np.arange(total - n + 1) - starts[row]) <= sizes[row] - n  # windows inside one text
    where = np.flatnonzero(good)
    if not len(where):
        none = np.zeros(0, np.int64)
        return none, none, none, none, h, starts
    change = np.flatnonzero((np.diff(at[where], prepend=-1) != 0) | (np.diff(row[where], prepend=-1) != 0))
    first = where[change]
    return row[first], first - starts[row[first]], np.diff(np.append(change, len(where))), g[at[first]].view(np.int64), h, starts


class Rank:
    """A bit vector, packed, with the count of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (16 - len(packed) % 8), np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletMatrix:
    """Rank of any symbol in a sequence, one packed bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> b) & 1
            self.levels.append((b, Rank(bits.astype(np.uint8))))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before i and before j."""
        base = np.zeros(len(symbol), np.int64)
        for b, level in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            oi, oj, ob = level.ones(i), level.ones(j), level.ones(base)
            i = np.where(one, level.zeros + oi, i - oi)
            j = np.where(one, level.zeros + oj, j - oj)
            base = np.where(one, level.zeros + ob, base - ob)
        return i - base, j - base


class FMIndex:
    """Matching statistics of many short word sequences among each other, up to CAP words. The sequences are indexed backwards, so that a step
    of backward search adds the word that follows."""

    CAP = 16

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        flat = np.concatenate([s[::-1] for s in sequences])
        self.alphabet, ids = np.unique(flat, return_inverse=True)
        text = np.zeros(len(flat) + len(sizes), np.int64)  # 0 stands after each sequence
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) + owner
        text[place] = ids + 1
        self.text, self.starts = text, np.cumsum(sizes + 1) - sizes - 1
        n = len(text)
        rank = text
        for k in (1, 2, 4, 8):  # order by the first 2, 4, 8, 16 symbols
            code = rank * (n + 1)
            code[: n - k] += rank[k:] + 1
            _, rank = np.unique(code, return_inverse=True)
        self.suffix = np.argsort(rank, kind="stable")
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))))
        self.bwt = WaveletMatrix(text[self.suffix - 1], len(self.alphabet) + 1)
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.last = self.starts + sizes - 1  # where a sequence's first word stands

    def matching_statistics(self, sequence: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place in a sequence of the index: words of the longest run from there that stands elsewhere too (CAP at most), and the rows
        [low, high) of the index for the run of `length` words.

        A run that is down to one row has found itself and is not followed further, nor are its rows made exact.
        """
        at, end = self.last[sequence] - place, self.starts[sequence]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.text), np.int64)
        found, rows = np.zeros(len(at), np.int64), (low.copy(), low + 1)
        live = np.arange(len(at))
        for step in range(self.CAP):
            live = live[at[live] - step >= end[live]]
            if not len(live):
                break
            c = self.text[at[live] - step]
            i, j = self.bwt.rank(c, low[live], high[live])
            low[live], high[live] = self.first[c] + i, self.first[c] + j
            live = live[j - i > 1]
            found[live] = step + 1
            if step + 1 == length:
                rows = low.copy(), high.copy()
        return found, *rows


def smallest_holders(sequences: list[np.ndarray], holder: np.ndarray, n: int) -> list[np.ndarray]:
    """For every n-word window of each sequence, the smallest holder among the sequences that contain it."""
    index = FMIndex(sequences)
    counts = np.array([len(s) - n + 1 for s in sequences], np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    found, low, high = index.matching_statistics(owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), n)
    out = holder[owner].copy()
    several = np.flatnonzero(found >= n)
    if len(several):
        pairs, back = np.unique(low[several], return_inverse=True)
        ends = np.zeros(len(pairs), np.int64)
        ends[back] = high[several]
        by_row = np.append(holder[index.owner[index.suffix]], np.iinfo(np.int64).max)
        cuts = np.stack((pairs, ends), 1).ravel()
        out[several] = np.minimum.reduceat(by_row, cuts)[::2][back]
    return np.split(out, np.cumsum(counts)[:-1])


def repeated_keys(docs: DataFrame, n: int) -> DataFrame:
    """Segment keys met in two documents or more: (key, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in blocks(texts_of(batch)):
                row, _, _, key, _, _ = segments(part, n)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id").take(pa.array(row + at))], ["key", "doc_id"])

    found = map_arrow(docs, run, "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("count"))
    return found.where("a < b").select("key", "count")


def digests(held: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers that tell equal segments."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in held]), "<i8").reshape(-1, 2)


def kept_segments(texts: list[bytes], n: int, table: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(row, first window, words, key) of the segments whose key may repeat; under a hot key each window by itself. Words
    are SYMBOL bytes each."""
    row, at, count, key, h, starts = segments(texts, n)
    ok = in_bloom(table, key)
    row, at, count, key = row[ok], at[ok], count[ok], key[ok]
    one = in_bloom(hot, key)
    times = np.where(one, count, 1)
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    row, at, key, one, count = np.repeat(row, times), np.repeat(at, times) + step, np.repeat(key, times), np.repeat(one, times), np.repeat(np.where(one, 1, count), times)
    begin = (starts[row] + at) * SYMBOL
    end = begin + (count + n - 1) * SYMBOL
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SYMBOL].tobytes()
    held = [raw[b:e] for b, e in zip(begin.tolist(), end.tolist())]
    if one.any():
        alone = np.flatnonzero(one)
        key[alone] = digests([held[i] for i in alone.tolist()])[:, 0]
    return row, at, held, key


def symbols(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // SYMBOL, 8), np.uint8)
    out[:, :SYMBOL] = np.frombuffer(held, np.uint8).reshape(-1, SYMBOL)
    return out.view(np.uint64)[:, 0]


def segment_classes(docs: DataFrame, n: int, spark_filter, hot) -> DataFrame:
    """(key, words, low, high): distinct segments of each task, with the smallest and largest document there. Equal segments
    are put together before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            key, low, high = zip(*found.values())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(list(found), pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["key", "words", "low", "high"])

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, part in blocks(texts_of(batch)):
                row, _, held, key = kept_segments(part, n, spark_filter.value, hot.value)
                for w, k, d in zip(held, key.tolist(), ids[row + first].tolist()):
                    if (known := found.get(w)) is None:
                        found[w] = [k, d, d]
                    elif d < known[1]:
                        known[1] = d
                    elif d > known[2]:
                        known[2] = d
                if len(found) > TASK_SEGMENTS:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    return map_arrow(docs, run, "key long, words binary, low long, high long")


def segment_places(docs: DataFrame, n: int, spark_filter, hot, spark_wanted) -> DataFrame:
    """(doc_id, tk, at, h1, h2) of the segments that may have to give up words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in blocks(texts_of(batch)):
                row, at, held, _ = kept_segments(part, n, spark_filter.value, hot.value)
                digest = digests(held)
                ok = in_bloom(spark_wanted.value, np.ascontiguousarray(digest[:, 0]))
                where = pa.array(row[ok] + first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), batch.column("tk").take(where), pa.array(at[ok]), pa.array(digest[ok, 0]), pa.array(digest[ok, 1])], ["doc_id", "tk", "at", "h1", "h2"])

    return map_arrow(docs, run, "doc_id long, tk long, at long, h1 long, h2 long")


def search_shards(classes: DataFrame, n: int) -> DataFrame:
    """(h1, h2, holders) of the segments of which a document has to give up words: holders has the smallest
    document of each window. h1 and h2 tell equal segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def flush(rows: list) -> pa.RecordBatch:
            words, low, high = zip(*rows)
            found = smallest_holders([symbols(w) for w in words], np.array(low, np.int64), n)
            keep = [i for i, f in enumerate(found) if high[i] > f.min()]
            digest = digests([words[i] for i in keep])
            return pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([found[i] for i in keep], pa.list_(pa.int64()))], ["h1", "h2", "holders"])

        key = None
        for batch in batches:
            for k, words, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "low", "high"))):
                if k != key and len(held) >= SHARD_SEGMENTS:
                    yield flush(held)
                    held = []
                key = k
                if held and held[-1][0] == words:
                    held[-1] = (words, min(low, held[-1][1]), max(high, held[-1][2]))
                else:
                    held.append((words, low, high))
        if held:
            yield flush(held)

    return map_arrow(classes, run, "h1 long, h2 long, holders array<long>")


def remove_repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """Remove every word that lies in an n-word window (n at most FMIndex.CAP) which also starts in a document with a smaller doc_id.

    Words are runs of characters other than ASCII white space, unchanged; windows are judged on the input.
    Returns (doc_id, n_words, n_removed, kept, text_removed as spans): kept is the text of the words left,
    joined by one space; spans is array<struct<first_word, words>> of what was removed. A null text has no
    words; texts under n words keep all. Rows with null doc_id are kept whole and stand for no other; rows with
    equal doc_id are never each other's repeats. No rows give no rows; other columns are not read. doc_id must
    be an integer. Words are compared by hashes of 40 bits, thirteen in a row.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("tk", F.xxhash64("text"))
    known = docs.where("doc_id is not null and text is not null")
    keys = save(repeated_keys(known, n))
    hot = spark.sparkContext.broadcast(bloom(keys.where(F.col("count") > HOT)))
    table = spark.sparkContext.broadcast(bloom(keys))

    shards = segment_classes(known, n, table, hot).repartition("key").sortWithinPartitions("key", "words")
    holders = save(search_shards(shards, n))
    wanted = spark.sparkContext.broadcast(bloom(holders.select(F.col("h1").alias("key"))))
    refs = segment_places(known, n, table, hot, wanted).join(holders, ["h1", "h2"])
    # the windows that go, by their first word
    windows = F.filter(F.transform("holders", lambda x, i: F.when(x < F.col("doc_id"), F.col("at") + i)), lambda w: w.isNotNull())
    refs = refs.select("doc_id", "tk", windows.alias("w")).where(F.size("w") > 0)
    gone = refs.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("w")).alias("gone"))
    return cut(docs.join(gone, ["doc_id", "tk"], "left"), n)


def cut(docs: DataFrame, n: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, spans = [], [], [], []
            gone = batch.column("gone")
            sizes = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends, starts = np.cumsum(sizes), gone.flatten().to_numpy(zero_copy_only=False)
            for text, end, size in zip(texts_of(batch), ends.tolist(), sizes.tolist()):
                words = text.split()
                total.append(len(words))
                if not size:
                    removed.append(0)
                    kept.append(b" ".join(words))
                    spans.append(())
                    continue
                at = starts[end - size : end]
                edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n, minlength=len(words) + 1)
                out = np.cumsum(edge)[:-1] > 0
                removed.append(int(out.sum()))
                turn = np.flatnonzero(np.diff(out.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                left, last = [], 0
                for s, e in turn:
                    left += words[last:s]
                    last = e
                kept.append(b" ".join(left + words[last:]))
                spans.append([{"first_word": s, "words": e - s} for s, e in turn])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return map_arrow(docs, run, f"doc_id {kind}, n_words long, n_removed long, kept string, spans array<struct<first_word:long,words:long>>")
