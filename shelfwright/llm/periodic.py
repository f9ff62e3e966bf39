"""Periodic runs of words (operator 12), by block convolution.

A run is a stretch that repeats with a smallest period q, at least 3 q (and 24) words long, and as long as it can be. At scale B = 8, 16, 32, ...
the text is cut into blocks of B words; a run whose period lies in the scale (up to 2 B - 1) holds a whole block together with its repetition one
period later. The sums of squared differences between a block and all places of the window behind it come from one convolution, by
number-theoretic transforms modulo several primes whose product is over any such sum: a sum is zero only if no word differs. Each zero is a block and a
distance; a stretch is extended from it to both sides until words at that distance differ.

Blocks that can't repeat are not transformed: each word of a block that repeats within the window must itself be found again within it. Nor
are blocks whose window lies in a run of a smaller period, since all their distances are multiples of that period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick, texts_of

#: Words that a run has at least, and repetitions.
LEAST, TIMES = 24, 3
#: Words of a block at the first scale: LEAST words hold a block and its repetition for every period under it.
FIRST = 8
#: Primes with roots of unity of large powers of two, each below 2^31, so that products fit in 63 bits.
PRIMES = (2013265921, 1811939329, 2113929217)
#: Numbers that are transformed at once.
CHUNK = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[tuple[int, int], tuple[list[np.ndarray], list[np.ndarray], int]] = {}


def roots(p: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Powers of the n-th root of unity and of its inverse modulo p, for each stage (half lengths n/2, n/4, ... 1), and 1/n."""
    if (p, n) not in _roots:
        w = next(r for g in range(2, 200) if pow(r := pow(g, (p - 1) // n, p), n // 2, p) == p - 1)

        def table(root: int) -> list[np.ndarray]:
            full = np.ones(n // 2, np.uint64)
            filled, step = 1, root
            while filled < n // 2:  # doubling: the second half is the first times a power
                full[filled : 2 * filled] = full[:filled] * np.uint64(step) % np.uint64(p)
                filled, step = 2 * filled, step * step % p
            out, stride = [], 1
            while n // 2 // stride >= 1:
                out.append(full[::stride].copy())
                stride *= 2
            return out

        _roots[p, n] = table(w), table(pow(w, -1, p)), pow(n, -1, p)
    return _roots[p, n]


def forward(a: np.ndarray, p: int) -> np.ndarray:
    """Transform of each row; the result is in bit-reversed order."""
    m, n = a.shape
    prime = np.uint64(p)
    for w in roots(p, n)[0]:
        x = a.reshape(m, -1, 2, len(w))
        low, high = x[:, :, 0], x[:, :, 1]
        a = np.stack(((low + high) % prime, (low + prime - high) * w % prime), 2).reshape(m, n)
    return a


def backward(a: np.ndarray, p: int) -> np.ndarray:
    """Inverse of forward."""
    m, n = a.shape
    prime = np.uint64(p)
    _, tables, scale = roots(p, n)
    for w in reversed(tables):
        x = a.reshape(m, -1, 2, len(w))
        low, high = x[:, :, 0], x[:, :, 1] * w % prime
        a = np.stack(((low + high) % prime, (low + prime - high) % prime), 2).reshape(m, n)
    return a * np.uint64(scale) % prime


def repetitions(codes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance), distances 1 .. 2 size - 1 at which the block of `size` words at each start stands again without a mismatch."""
    n = len(codes)
    stop = int(codes.max()) + 1  # stands behind the end: in no block
    used, room = 0, 1
    while room <= size * (stop + 1) ** 2:
        room *= PRIMES[used]
        used += 1
    padded = np.concatenate((codes, np.full(3 * size, stop, codes.dtype))).astype(np.uint64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    many = max(1, CHUNK // (4 * size))
    for at in range(0, len(starts), many):
        some = starts[at : at + many]
        window = padded[some[:, None] + np.arange(3 * size)]
        zero = np.ones((len(some), 2 * size), bool)
        for p in PRIMES[:used]:
            prime = np.uint64(p)
            x = np.zeros((2 * len(some), 4 * size), np.uint64)
            x[: len(some), : 3 * size] = window % prime
            x[len(some) :, :size] = window[:, :size][:, ::-1] % prime
            y = forward(x, p)
            cross = backward(y[: len(some)] * y[len(some) :] % prime, p)[:, size - 1 : 3 * size - 1]
            square = x[: len(some), : 3 * size] ** 2 % prime
            sums = np.concatenate((np.zeros((len(some), 1), np.uint64), np.cumsum(square, 1)), 1)
            own = sums[:, size : size + 1]
            there = sums[:, size : 3 * size] - sums[:, : 2 * size]
            zero &= (own + there + 2 * (prime - cross)) % prime == 0
        row, distance = np.nonzero(zero[:, 1:])
        out.append((some[row], distance + 1))
    return tuple(np.concatenate(x) for x in zip(*out))


def agree(codes: np.ndarray, i: int, d: int, step: int) -> int:
    """How many words in a row from i on (step 1), or up to i (step -1), equal those d later."""
    end = len(codes) - d
    n, size = 0, 32
    while True:
        if step > 0:
            lo, hi = i + n, min(i + n + size, end)
            differ = codes[lo:hi] != codes[lo + d : hi + d]
        else:
            lo, hi = max(0, i - n - size + 1), i - n + 1
            differ = (codes[lo:hi] != codes[lo + d : hi + d])[::-1]
        if hi <= lo:
            return n
        if differ.any():
            return n + int(differ.argmax())
        n += hi - lo
        size *= 2


def runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a sequence of small numbers: (start, length, period), by start, then period."""
    n = len(codes)
    if n < LEAST:
        return []
    order = np.argsort(codes, kind="stable")
    again = np.full(n, n, np.int64)  # distance to the next equal word
    same = codes[order[1:]] == codes[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    found: dict[tuple[int, int], int] = {}
    size, low = FIRST, 1
    while TIMES * low <= n:
        blocks = n // size
        starts = np.flatnonzero(again[: blocks * size].reshape(blocks, size).max(1) < 2 * size) * size
        reach = np.zeros(n, np.int64)  # how far the runs go that begin here or before
        if len(starts) and found:
            np.maximum.at(reach, [s for s, _ in found], [e for _, e in found])
            reach = np.maximum.accumulate(reach)
            starts = starts[reach[starts] < np.minimum(starts + 3 * size - 1, n)]
        if len(starts):
            at, distance = repetitions(codes, starts, size)
            keep = (distance >= low) & (reach[at] < at + size + distance)  # a repetition inside a run is one of its own
            at, distance = at[keep], distance[keep]
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            parts = np.flatnonzero(np.diff(distance, prepend=0, append=n + 1))
            for lo, hi in zip(parts[:-1], parts[1:]):
                d, places, k = int(distance[lo]), at[lo:hi], 0
                while k < len(places):
                    i = int(places[k])
                    first = i - agree(codes, i - 1, d, -1) if i else 0
                    last = i + size + agree(codes, i + size, d, 1)
                    if last + d - first >= max(LEAST, TIMES * d):
                        found.setdefault((first, last + d), d)  # the smallest distance comes first
                    k = int(np.searchsorted(places, last))
        size, low = 2 * size, 2 * size
    return sorted((s, e - s, d) for (s, e), d in found.items())


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; of equals the first, then that of the smaller period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 0."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every whole text: all runs as array<struct<start, length, period>> by start and period, the
    strongest, and the words outside the repetitions - those that no run contains after its first period - joined by one space.

    A null or empty text has no words and no runs; words are compared themselves. Repeated rows stay, rows without doc_id too; no rows give no
    rows; other columns are not read. A text is one row and so one task's; time is in proportion to its words, times the number of scales.
    """
    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    told = lambda r: dict(zip(("start", "length", "period"), r)) if r else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, all_, best, kept = [], [], [], []
            for text in texts_of(batch):
                words = text.split()  # bytes: at the six characters of WORD
                found = runs(numbered(words))
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s, length, q in found:
                        edge[s + q] += 1
                        edge[s + length] -= 1
                    words, n = [w for w, gone in zip(words, np.cumsum(edge)) if not gone], len(words)
                else:
                    n = len(words)
                size.append(n)
                all_.append([told(r) for r in found])
                best.append(told(strongest(found)))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(all_, pa.list_(run)), pa.array(best, run), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "best", "collapsed"])

    each = "struct<start:long,length:long,period:long>"
    return map_arrow(docs, work, f"doc_id {kind}, n_words long, runs array<{each}>, best {each}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h the crc32 of doc_id and g = h // 10, every document with h % 10 = 0 and n words repeats its words a .. a + p - 1 from
    word a = g % n on, p = 1 + (n - a) // (3 + g % 8). Documents without doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = pick(docs, "doc_id", "text").withColumn("g", F.when(h % 10 == 0, g))
    rows = rows.withColumn("w", F.when(F.col("g").isNotNull(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    unit: Column = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Figures and digests of find_runs: (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words)."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
