"""Packing of token sequences (operator 3).

Documents are encoded where they lie and cut at multiples of the sequence length. Only the pieces'
lengths are shuffled: into random groups of bounded size, each packed on its own by first-fit
decreasing. A tournament tree over the bins' free space finds the first bin that fits in logarithmic time.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_arrow, pick, save, ship, texts_of

SEQUENCE = 2048
#: Pieces in a group, as a mean; a group is what one task holds at once.
GROUP_PIECES = 2048
#: Words whose ids one Python worker keeps, and new ones that are encoded at once.
CACHE_WORDS, LEARN_WORDS = 1_200_000, 20_000
#: Letters that normalisation leaves alone and that have one lower-case letter, then signs that are no apostrophe or angle bracket.
LETTERS_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{-~]*)")


class WordEncoder:
    """Ids of whole texts, word by word.

    For a vocabulary that drops white space, no token crosses it, so a text's ids are those of its
    white-space separated words in a row; each distinct word is encoded once by the library. Letters and the
    signs behind them never share a token either, and case is dropped, so a word of letters and signs
    is put together from its letters in lower case and its signs. Many such parts are encoded as one text; each
    ends where the library gives a token with a word end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores out
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for t, n in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode_parts(self, parts: list[str]) -> None:
        """Learn parts that are one pre-token each."""
        for k in range(0, len(parts), LEARN_WORDS):
            some = parts[k : k + LEARN_WORDS]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            assert len(ends) == len(some)
            raw = ids.tobytes()
            self.known.update(zip(map(str.encode, some), [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        whole, parts, new = [], [], set()
        words = list(words)
        texts = b"\n".join(words).decode("utf-8", "surrogatepass").split("\n")  # no word holds a line feed
        for w, text, m in zip(words, texts, map(LETTERS_AND_SIGNS.fullmatch, texts)):
            if m is None:
                whole.append((w, text))
            else:
                a, b = m.groups()
                parts.append((w, a := a.lower(), b))
                new.add(a)
                new.add(b)
        new.discard("")
        self._encode_parts([x for x in new if x.encode() not in known])
        for (w, _), e in zip(whole, self.library.encode_batch_fast([t for _, t in whole], add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
        for w, a, b in parts:
            known[w] = known[a.encode()] + known[b.encode()] if b else known[a.encode()]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            size, part = 0, []
            while at < len(texts) and (not part or size + len(texts[at]) < 4_000_000):
                part.append(texts[at].split())
                size += len(texts[at])
                at += 1
            found = [list(map(self.known.get, words)) for words in part]
            if new := {w for words, f in zip(part, found) if None in f for w, x in zip(words, f) if x is None}:
                known = self.known
                if len(known) + 2 * len(new) > CACHE_WORDS:
                    known.clear()
                    found, new = [[None] * len(words) for words in part], {w for words in part for w in words}
                self._learn(new)
                found = [[known[w] if x is None else x for w, x in zip(words, f)] if None in f else f for words, f in zip(part, found)]
            out += [b"".join(f) for f in found]
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut_documents(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """Encode every whole text, add end_id, cut at multiples of `length`: one row a piece.

    (doc_id, start, length, ids_crc32, doc_tokens, salt): salt is the piece's place in its task, so that
    repeated rows spread over the groups. A null text is empty and still has the end id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, salt = encoder(path), 0
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, starts, sizes, crcs, totals = [], [], [], [], []
            for row, ids in enumerate(enc.ids(texts_of(batch))):
                ids += tail
                n = len(ids) // 4
                for s in range(0, n, length):
                    part = ids[4 * s : 4 * (s + length)]
                    at.append(row)
                    starts.append(s)
                    sizes.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(n)
            whole = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(whole(at)), whole(starts), whole(sizes), whole(crcs), whole(totals), whole(range(salt, salt + len(at)))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
            salt += len(at)

    return map_arrow(pick(docs, "doc_id", "text"), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, by first-fit decreasing; ties in the given order.

    Node k of the tournament tree holds the most free space of the bins below it, so going left
    whenever the left half can take the piece leads to the first bin that fits.
    """
    n = len(sizes)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        size, k = int(sizes[i]), 1
        while k < leaves:
            k *= 2
            if tree[k] < size:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - tree[k]
        tree[k] -= size
        while k > 1:
            k //= 2
            tree[k] = max(tree[2 * k], tree[2 * k + 1])
    return bins, offsets


def pack(pieces: DataFrame, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece (cut_documents) a sequence and an offset in it, without gaps from 0.

    Groups are random (a hash of the piece) and each is packed on its own, so sequence_id is the group
    number times 2^32 plus the bin. Rows are never dropped; no rows give no rows.
    """
    pieces = save(pieces)
    ship(pieces.sparkSession)
    groups = max(1, -(-pieces.count() // group_pieces))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "start", "salt"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(np.int64), length)
        return pd.DataFrame({"doc_id": group["doc_id"], "start": group["start"], "length": group["length"], "ids_crc32": group["ids_crc32"], "doc_tokens": group["doc_tokens"], "sequence_id": (int(key[0]) << 32) + bins, "offset": offsets})

    return (
        pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(groups)))
        .groupBy("pack_group")
        .applyInPandas(one, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, path: str, length: int = SEQUENCE) -> DataFrame:
    """Encode, cut and pack all documents; see cut_documents and pack. Other columns are not read."""
    return pack(cut_documents(docs, path, length), length)
