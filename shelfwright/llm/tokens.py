"""Token counts at every prefix of a text (operator 9).

For byte-pair merges, the encoding of a prefix is known from the last token of shorter prefixes: the
token that ends at position i and starts at j is right when it may stand after the last token of the
prefix of length j. So one pass over a word gives the exact count at each of its prefixes. What is known of
a word's prefix holds for all words that begin with it and is kept. A text's counts are those at its words'
ends, as running sums, and inside a word those of the word: truncation and budget questions are then
look-ups; nothing is encoded again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, pick, texts_of

#: Words kept by one Python worker, none of LONGEST letters or more.
CACHE_WORDS, LONGEST = 1_000_000, 64
#: First letters of a word whose walk is kept for other words, and such walks at most.
SHARED, STATES = 5, 200_000
#: Fixed values of the tokenizer file's pre-tokenizer and special strings.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SPACES = regex.compile(rb"[\x20\x09-\x0D]+")
#: ASCII letters, then signs that are no apostrophe or angle bracket: two pre-tokens.
LETTERS_AND_SIGNS = regex.compile(rb"([A-Za-z]+)([!-&(-/:;=?@\[-`{-~]*)")
RUNS = regex.compile(r"[\p{L}]+|[^\s\p{L}\p{N}]+")
#: Stands for the start of a word where a token is asked for.
START = -1


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


@cache
def joining() -> frozenset[str]:
    """Letters that normalisation (NFC) may join with what stands before them."""
    out = {chr(x) for lo, hi in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for x in range(lo, hi)}
    for x in range(0x110000):
        c = chr(x)
        if unicodedata.combining(unicodedata.normalize("NFD", c)[0]):
            out.add(c)
        elif (d := unicodedata.decomposition(c)) and d[0] != "<" and len(parts := d.split()) == 2:
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def normal(text: str) -> str:
    """NFC, then each letter in lower case by itself."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class PrefixCounter:
    """Exact token counts at every prefix, for a merge vocabulary with word ends (`</w>`).

    A token's number is its merge's place, so of two tokens the larger is made later.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        number = {t: i for i, t in enumerate(sorted(t for t in model["vocab"] if t not in made))}
        self.base = len(number)
        self.left, self.right, self.pair = [0] * self.base, [0] * self.base, {}
        good = [True] * self.base
        for a, b in merges:
            x, y, n = number[a], number[b], len(self.left)
            good.append(good[x] and good[y] and self._apart(x, y, n))
            number[a + b] = n
            self.left.append(x)
            self.right.append(y)
            self.pair[x << 17 | y] = n
        self._find_suffixes({t: n for t, n in number.items() if good[n]})
        self.letters = byte_letters()
        self.words = regex.compile(WORD_PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, SPECIAL)))
        self.fit: dict[int, bool] = {}
        self.states: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.pieces: dict[str, int] = {}
        self.totals: dict[bytes, int] = {}

    def _find_suffixes(self, tokens: dict[str, int]) -> None:
        """A state for each beginning of a token: where a letter leads, and the tokens that end there, longest first:
        (letters, token inside a word, token at its end), START where there is none."""
        self.next: list[dict[str, int]] = [{}]
        inner, last = {}, {}
        for t, n in tokens.items():
            end = t.endswith("</w>")
            at = 0
            for c in t[:-4] if end else t:
                if (to := self.next[at].get(c)) is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                at = to
            (last if end else inner)[at] = n
        self.shorter = [0] * len(self.next)
        self.ends: list[tuple] = [()] * len(self.next)
        level, depth = [0], 0
        while level:
            for at in level:
                own = ((depth, inner.get(at, START), last.get(at, START)),) if at in inner or at in last else ()
                self.ends[at] = own + (self.ends[self.shorter[at]] if at else ())
            for at in level:
                for c, to in self.next[at].items():
                    self.shorter[to] = self._lead(self.shorter[at], c) if at else 0
            level, depth = [to for at in level for to in self.next[at].values()], depth + 1
        self.longest = depth

    def _lead(self, at: int, c: str) -> int:
        while (to := self.next[at].get(c)) is None and at:
            at = self.shorter[at]
        return to or 0

    def _apart(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Do merges before `limit` leave a and b apart, where they stand side by side?

        Going back in time, the part made last is taken apart; the halves that then touch must not have been joined before.
        Of two merges of one rank the left one comes first.
        """
        while True:
            if self.pair.get(a << 17 | b, limit) < limit:
                return False
            if max(a, b) < self.base:
                return True
            if a > b:
                limit = min(limit, a)
                a = self.right[a]
            else:
                limit = min(limit, b + 1)
                b = self.left[b]

    def _fits(self, a: int, b: int) -> bool:
        """May token b stand after token a?"""
        key = a << 17 | b
        if (known := self.fit.get(key)) is None:
            known = self.fit[key] = self._apart(a, b)
        return known

    def _whole(self, tokens: list[int], counts: list[int], at: int, i: int = -1) -> int:
        """Count of the word that ends after the i-th prefix, whose state is `at`."""
        for k, _, t in self.ends[at]:
            if t != START:
                a = tokens[i - k]
                if a == START:
                    return 1
                if self._fits(a, t):
                    return counts[i - k] + 1
        raise ValueError("no token at the end of a word")

    def _walk(self, s: str) -> tuple[list[int], list[int], list[int]]:
        """Last token, count and state of every prefix of a word inside it."""
        known = self.states
        if len(known) > STATES:
            known.clear()
        head = s[:SHARED]
        if (walk := known.get(head)) is None:
            walk = known[head] = self._go(([START], [0], [0]), head)
        return self._go(tuple(x.copy() for x in walk), s[SHARED:])

    def _go(self, walk: tuple, s: str) -> tuple[list[int], list[int], list[int]]:
        """A walk, gone on with over more letters."""
        tokens, counts, states = walk
        at, shorter, nexts, ends, fit = states[-1], self.shorter, self.next, self.ends, self.fit
        for c in s:
            while (to := nexts[at].get(c)) is None and at:
                at = shorter[at]
            at = to or 0
            for k, t, _ in ends[at]:
                if t != START:
                    a = tokens[-k]
                    if a == START:
                        tokens.append(t)
                        counts.append(1)
                        break
                    if (known := fit.get(a << 17 | t)) is None:
                        known = self._fits(a, t)
                    if known:
                        tokens.append(t)
                        counts.append(counts[-k] + 1)
                        break
            states.append(at)
        return walk

    def _as_letters(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))

    def piece(self, word: str) -> int:
        """Token count of one pre-token."""
        if (n := self.pieces.get(word)) is None:
            tokens, counts, states = self._walk(self._as_letters(word))
            n = self._whole(tokens, counts, states[-1])
            if len(word) < LONGEST:
                if len(self.pieces) > CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[word] = n
        return n

    def prefixes(self, word: str) -> tuple[list[int], tuple]:
        """Token count of word[:k] standing alone, for k = 1 ... len(word); and the walk that told them."""
        walk = tokens, counts, states = self._walk(self._as_letters(word))
        raw = word.encode("utf-8", "surrogatepass")
        n = len(raw)
        out = [self._whole(tokens, counts, states[i], i) for i in range(1, n + 1) if i == n or raw[i] & 0xC0 != 0x80]
        if word in ("'re", "'ve", "'ll"):  # shorter, these are two pre-tokens
            out[1] = self.piece("'") + self.piece(word[1])
        return out, walk

    def _plain_total(self, text: str) -> int:
        """Count of a normalised text without special strings."""
        return sum(map(self.piece, self.words.findall(text)))

    def _plain(self, text: str) -> list[int]:
        """Counts for a normalised text without special strings, at 1 ... len(text)."""
        out, base, at = [], 0, 0
        for m in self.words.finditer(text):
            out += [base] * (m.start() - at)
            at = m.end()
            out += [base + k for k in self.prefixes(m[0])[0]]
            base = out[-1]
        return out + [base] * (len(text) - at)

    def _segment(self, text: str) -> list[int]:
        """Counts for a text without special strings, by its own code points."""
        lower = text.lower() if text.isascii() else [c.lower() for c in text]
        if text.isascii() or (unicodedata.is_normalized("NFC", text) and all(len(c) == 1 for c in lower)):
            return self._plain("".join(lower))
        return self._joined(text)

    def _joined(self, text: str) -> list[int]:
        """The same where normalisation joins, splits or adds letters. A normalised prefix of the text is a prefix of the normalised text
        but for the group of joining letters it ends in, so only the prefixes inside a group are told by themselves: each goes on from
        the walk over what stands before the group."""
        joins = joining()
        cuts = [0, *[i for i in range(1, len(text)) if text[i] not in joins], len(text)]
        groups = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        whole, out, base = "".join(map(normal, groups)), [], 0
        found = self.words.finditer(whole)
        counts, spans = [0], []
        for m in found:
            counts += [counts[-1]] * (m.start() + 1 - len(counts))
            base = counts[-1]
            more, walk = self.prefixes(m[0])
            counts += [base + k for k in more]
            spans.append((m.start(), m.end(), base, walk if m.end() - m.start() >= LONGEST else None))
        counts += [counts[-1]] * (len(whole) + 1 - len(counts))
        at, e, place = -1, 0, 0  # letters of `whole` before the group, and bytes of its last pre-token
        for group in groups:
            now = normal(group)
            after = e + len(now)
            while at + 1 < len(spans) and spans[at + 1][0] < e:
                at += 1
                place = len(whole[spans[at][0] : e].encode("utf-8", "surrogatepass"))
            start, end, base, walk = spans[at] if at >= 0 else (e, e, 0, None)
            if at > 0 and whole[spans[at - 1][0] : start] == "'" and walk is None:  # may become one pre-token with what follows
                start, base = spans[at - 1][0], spans[at - 1][2]
            for k in range(1, len(group)):
                x = normal(group[:k])
                if end < e or start == e:  # a gap before the group
                    out.append(counts[e] + self._plain_total(x))
                elif walk is None or not (head := RUNS.match(whole[e - 1] + x)) or head.end() < 2:
                    before = whole[start:e] if walk is None else ""
                    out.append((base if walk is None else counts[e]) + self._plain_total(before + x))
                else:  # a long run of letters or signs that goes on
                    out.append(base + self._go_on(walk, place, x[: head.end() - 1]) + self._plain_total(x[head.end() - 1 :]))
            out.append(counts[after])
            place += len(now.encode("utf-8", "surrogatepass"))
            e = after
        return out

    def _go_on(self, walk: tuple, place: int, more: str) -> int:
        """Count of the word made of the first `place` bytes of a walked word, and `more`."""
        low = max(0, place + 1 - self.longest - 1)
        tokens, counts, states = self._go(tuple(x[low : place + 1] for x in walk), self._as_letters(more))
        return self._whole(tokens, counts, states[-1])

    def chunk(self, text: str) -> list[int]:
        """Counts of a text without ASCII white space, at 1 ... its length."""
        out, at, base = [], 0, 0
        for m in self.special.finditer(text):
            part = self._segment(text[at : m.end() - 1])
            out += [base + k for k in part]
            base += (part[m.start() - at - 1] if m.start() > at else 0) + 1
            out.append(base)
            at = m.end()
        return out + [base + k for k in self._segment(text[at:])]

    def _total(self, word: bytes) -> int:
        if (m := LETTERS_AND_SIGNS.fullmatch(word)) is not None:
            n = self.piece(m[1].lower().decode())
            return n + self.piece(m[2].decode()) if m[2] else n
        text = word.decode("utf-8", "surrogatepass")
        if "<|" not in text:
            return self._plain_total(normal(text))
        found = self.special.findall(text)
        return len(found) + sum(self._plain_total(normal(part)) for part in self.special.split(text))

    def total(self, word: bytes) -> int:
        """Token count of a word: a run without ASCII white space."""
        n = self._total(word)
        if len(word) < LONGEST:
            if len(self.totals) > CACHE_WORDS:
                self.totals.clear()
            self.totals[word] = n
        return n

    def word_ends(self, words: list[bytes]) -> np.ndarray:
        """Token count of a text at the end of each of its words."""
        found = list(map(self.totals.get, words))
        if None in found:
            found = [self.total(w) if n is None else n for w, n in zip(words, found)]
        return np.cumsum(np.array(found, np.int64))

    def longest_within(self, text: bytes, words: list[bytes], ends: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens: the words before the first that goes beyond, and its part."""
        k = int(np.searchsorted(ends, budget, side="right"))
        if k == len(words):
            return len(text.decode("utf-8", "surrogatepass"))
        before = text[: len(text) - len(text.split(None, k)[k])]
        inside = self.chunk(words[k].decode("utf-8", "surrogatepass"))
        left = budget - (int(ends[k - 1]) if k else 0)
        return len(before.decode("utf-8", "surrogatepass")) + max((i for i, n in enumerate(inside, 1) if n <= left), default=0)

    def counts(self, text: bytes) -> np.ndarray:
        """Token count of every prefix of a whole text: item k is for the first k code points."""
        words = text.split()
        ends = self.word_ends(words)
        parts, at, base = [[0]], 0, 0
        for w, end in zip(words, ends.tolist()):
            to = text.index(w, at)
            parts.append([base] * (to - at))
            parts.append([base + n for n in self.chunk(w.decode("utf-8", "surrogatepass"))])
            base, at = end, to + len(w)
        parts.append([base] * (len(text) - at))
        return np.concatenate([np.array(p, np.int64) for p in parts])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary file and Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, budget: int = 2048, prefixes: bool = False, key: str = "doc_id") -> DataFrame:
    """Token counts of every text, by prefix dynamic programming.

    Returns (key, n_bytes, n_tokens, over_limit, fit_chars): fit_chars is the length in code points of the
    longest prefix of at most `budget` tokens. With prefixes=True, also prefix_tokens array<int>: item k
    is the exact count of the first k code points. A null text counts as empty (0 tokens); a null key and
    repeated rows are kept as they are; no rows give no rows; other columns are not read. The time is in proportion to a
    text's length, with and without white space.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                words = text.split()
                ends = c.word_ends(words)
                n = int(ends[-1]) if words else 0
                rows.append((len(text), n, n > budget, c.longest_within(text, words, ends, budget), c.counts(text).astype(np.int32) if prefixes else None))
            columns = list(zip(*rows)) if rows else [()] * 5
            arrays = [batch.column(key), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int64())]
            names = [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if prefixes:
                arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(arrays, names)

    more = ", prefix_tokens array<int>" if prefixes else ""
    return map_arrow(pick(docs, key, "text"), run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long{more}")
