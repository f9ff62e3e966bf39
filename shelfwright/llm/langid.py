"""Language identification of mixed-language text (operator 7).

Unicode script ranges narrow the candidate languages of each word, a naive-Bayes model over its byte
n-grams scores them, and Viterbi with a switching penalty labels the words, so that a text falls into
spans of one language each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, pick, texts_of
from .words import blocks

#: Documents of each language that the model learns from, at most (about: a hash decides).
SAMPLE_DOCS = 1500
BUCKETS = 1 << 15
#: Cost, in nats, of a change of language between two words.
SWITCH = 8.0
#: N-grams overlap, so a word's score is its log-likelihood divided by this.
OVERLAP = 3.0
#: No word counts more than this against a language.
WORST = -6.0
CACHE_WORDS = 400_000
UNKNOWN = "und"

#: First code points of the ranges that the script of a letter is told by (Unicode blocks, fixed values).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it a letter, and the number of its script."""
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    block = np.array([NAMES.index(n) for _, n in SCRIPTS], np.uint8)
    return alpha, np.repeat(block, np.diff(np.append(STARTS, 0x110000)))


def scripts_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and the number of the script of most of them (of equals the first name); -1 without letters."""
    alpha, block = letter_tables()
    text = b" ".join(words).decode("utf-8", "surrogatepass")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner, good = np.cumsum(codes == 32), alpha[codes]
    owner, codes = owner[good], codes[good]
    letters = np.bincount(owner, minlength=len(words))
    held = np.bincount(owner * len(NAMES) + block[codes], minlength=len(words) * len(NAMES)).reshape(-1, len(NAMES))
    return letters, np.where(letters > 0, held.argmax(1), -1)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 1- to 4-grams of blank-padded words, and each one's word."""
    raw = np.frombuffer(b" " + b" ".join(words) + b"    ", np.uint8).astype(np.uint64)
    n = len(raw) - 4
    word = np.cumsum(raw[:n] == 32) - 1
    out, owner = [], []
    code = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    for k in range(4):
        code = code * np.uint64(257) + raw[k : n + k]
        if k:
            open_ = open_ & (raw[k - 1 : n + k - 1] != 32) if k > 1 else open_
        good = open_ & (word < len(words)) & ((raw[:n] != 32) if k == 0 else True)
        h = (code[good] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int64))
        owner.append(word[good])
    return np.concatenate(out), np.concatenate(owner)


class Model:
    """Language names, log-likelihood of each n-gram bucket, and which languages each script admits."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])).T.astype(np.float32) if langs else np.zeros((BUCKETS, 0), np.float32)
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True)) if langs else np.zeros((0, len(NAMES)))
        self.admits = share >= 0.005
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("langs", "logp", "admits")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def _learn(self, words: list[bytes]) -> None:
        bucket, owner = grams([w.lower() for w in words])
        k = len(self.langs)
        score = np.empty((len(words), k), np.float32)
        for j in range(k):
            score[:, j] = np.bincount(owner, self.logp[bucket, j], len(words)) / OVERLAP
        letters, script = scripts_of(words)
        admits = self.admits[:, script].T & (script >= 0)[:, None]
        some = admits.any(1)
        score[~some] = 0  # no letters, or a script that no language was seen in: says nothing
        score[some[:, None] & ~admits] = -np.inf
        score = np.maximum(score - score.max(1, keepdims=True, initial=-np.inf), WORST) if k else score
        base = len(self.known)
        while base + len(words) > len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
        self.scores[base : base + len(words)] = score
        self.letters[base : base + len(words)] = letters
        self.known.update(zip(words, range(base, base + len(words))))

    def label(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the language (its number) of every word, and the words' letter counts. New words of many texts are scored together."""
        for _, part in blocks(texts):
            held = [t.split() for t in part]
            words = list(chain.from_iterable(held))
            found = list(map(self.known.get, words))
            if None in found:
                new = list({w for w, x in zip(words, found) if x is None})
                if len(self.known) + len(new) > CACHE_WORDS and self.known:
                    self.reset()
                    new = list(set(words))
                    found = [None] * len(words)
                self._learn(new)
                known = self.known
                found = [known[w] if x is None else x for w, x in zip(words, found)]
            at = np.array(found, np.int64)
            score, letters = self.scores[at].astype(np.float64), self.letters[at]
            end = 0
            for w in held:
                start, end = end, end + len(w)
                yield viterbi(score[start:end], SWITCH), letters[start:end]


def viterbi(score: np.ndarray, switch: float) -> np.ndarray:
    """Labels of the best path: sum of word scores less `switch` for each change; ties to the smaller label.

    One label throughout is best for sure if no stretch of words speaks for another by more than the switching
    cost, and no two at both ends of the text do so together; running sums show that without a step for each word.
    """
    n, k = score.shape
    if n == 0 or k == 0:
        return np.zeros(n, np.int64)
    top = int(np.argmax(score.sum(0)))
    lead = np.cumsum(score - score[:, top : top + 1], axis=0)
    low = np.minimum.accumulate(np.concatenate((np.zeros((1, k)), lead[:-1])), axis=0)
    if (lead - low).max() <= switch and lead.max() + (lead[-1] - np.concatenate((np.zeros((1, k)), lead[:-1]))).max() <= switch:
        return np.full(n, top, np.int64)
    best, back = score[0].tolist(), np.zeros((n, k), np.int64)
    for i, row in enumerate(score[1:].tolist(), 1):
        m = max(best)
        j = best.index(m)
        now = []
        for x in range(k):
            if best[x] >= m - switch:
                now.append(best[x] + row[x])
                back[i, x] = x
            else:
                now.append(m - switch + row[x])
                back[i, x] = j
        best = now
    out = np.zeros(n, np.int64)
    at = best.index(max(best))
    for i in range(n - 1, -1, -1):
        out[i] = at
        at = back[i, at]
    return out


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from documents (doc_id, text, lang) with known language.

    About `sample_docs` documents of each language are taken, by a hash of doc_id; their n-gram counts
    (BUCKETS a language) come to the driver. Null texts and null languages teach nothing.
    """
    labelled = pick(labelled, "doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(NAMES))))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, 2 * int(2**62 * min(1.0, sample_docs / sizes[lang])) - 1)])
    sample = labelled.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("lang")), 1) <= share[F.col("lang")])
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS + len(NAMES)), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                words = text.split()
                if words:
                    total[number[lang], :BUCKETS] += np.bincount(grams([w.lower() for w in words])[0], minlength=BUCKETS)
                    script = scripts_of(words)[1]
                    total[number[lang], BUCKETS:] += np.bincount(script[script >= 0], minlength=len(NAMES))
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], ["l", "b", "n"])

    counts = np.zeros((len(langs), BUCKETS + len(NAMES)), np.int64)
    for r in map_arrow(sample, run, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect():
        counts[r["l"], r["b"]] = r["n"]
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS:])


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Language of every whole text: (doc_id, lang_pred, score), and with spans=True the labelled spans.

    lang_pred is the language whose words hold most letters; score is its share of the letters (0 to 1).
    `und` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows stay;
    other columns are not read. spans: array of (first word, words, language).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, found = [], [], []
            for labels, letters in model.label(texts_of(batch)):
                total = int(letters.sum()) if model.langs else 0
                if not total:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    found.append([])
                    continue
                weight = np.bincount(labels, letters, len(model.langs))
                top = int(np.argmax(weight))
                langs.append(model.langs[top])
                scores.append(float(weight[top] / total))
                if spans:
                    cuts = np.flatnonzero(np.diff(labels)) + 1
                    starts = [0, *cuts.tolist()]
                    found.append([{"first_word": s, "words": e - s, "lang": model.langs[int(labels[s])]} for s, e in zip(starts, [*starts[1:], len(labels)])])
            arrays, names = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names)

    more = ", spans array<struct<first_word:long,words:long,lang:string>>" if spans else ""
    return map_arrow(pick(docs, "doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double{more}")


def identify_rows(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The documents with all their columns, and lang_pred and score as in identify under the given names (columns of these are replaced)."""
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for labels, letters in model.label(texts_of(batch)):
                total = int(letters.sum()) if model.langs else 0
                weight = np.bincount(labels, letters, max(1, len(model.langs)))
                top = int(np.argmax(weight))
                langs.append(model.langs[top] if total else UNKNOWN)
                scores.append(float(weight[top] / total) if total else 0.0)
            yield batch.append_column(names[0], pa.array(langs, pa.string())).append_column(names[1], pa.array(scores, pa.float64()))

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return map_arrow(docs, run, schema)


def held_out() -> F.Column:
    """crc32(doc_id as text) mod 5 is 0; a document without id is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
