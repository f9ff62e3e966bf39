"""Texts without white space, of hundreds of thousands of letters, and letters that normalisation joins."""

import random
import time

import pytest
from tokenizers import Tokenizer

from shelfwright.llm import decontam, fingerprint, jaccard, langid, licenses, packing, pii, queries, substring, tokens

RUNS = [
    "ab" * 100_000, "漢" * 100_000, "é" * 50_000, "한" * 30_000, "İ" + "漢" * 100_000, "@" + "aB3/+" * 60_000, "1.2" * 60_000, "+1" + "-2" * 90_000, "$" * 200_000,
    "x@" + "y." * 100_000, "0 " * 100_000,
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(list(enumerate(RUNS)), "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path("word_bpe_49k.json")


def test_prefix_counts_of_joined_letters(path):
    """Every prefix against the library, with letters that are joined, split, reordered or lower-cased to several."""
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    counter, rng = tokens.PrefixCounter(path), random.Random(1)
    letters = "abcdeé'ßİΣςǅ日本語한̧́éཱི̈́<|endoftext|>sllvered012½$%&.,  ͅńक़Å"
    parts = ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "'re", "don't", "é", "한", "İ"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.15 else rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(800)]
    texts += ["a" * 70 + "é" * 3 + "x", "é" * 80 + "ȩ́s", "한" * 40 + "'" + "ś", "$" * 70 + "̧́a"]
    for text in texts:
        want = [len(e.ids) for e in library.encode_batch([text[:k] for k in range(len(text) + 1)], add_special_tokens=False)]
        raw = text.encode()
        assert counter.counts(raw).tolist() == want, ascii(text)
        words = raw.split()
        for budget in (0, 1, 3):
            assert counter.longest_within(raw, words, counter.word_ends(words), budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_tokens_of_long_runs(runs, path):
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(RUNS)}
    start = time.time()
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(runs, path).collect()} == want
    packed = packing.pack_documents(runs, path).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id: r[1] - 1 for r in packed} == want
    assert time.time() - start < 120


@pytest.mark.parametrize("name", ["substring", "pii", "jaccard", "licenses", "langid", "fingerprint", "decontam"])
def test_other_operators_on_long_runs(spark, runs, name):
    """They end, within minutes, and give a row for each text (decontamination: for none)."""
    labelled = spark.createDataFrame([(1, "the of and", "en"), (2, "le la les", "fr")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    make = {
        "substring": lambda: substring.remove_repeats(runs), "pii": lambda: pii.digest(pii.find_spans(runs)), "jaccard": lambda: jaccard.jaccard_classes(runs), "licenses": lambda: licenses.scan(runs),
        "langid": lambda: langid.identify(runs, langid.fit(labelled)), "fingerprint": lambda: fingerprint.fingerprints(runs), "decontam": lambda: decontam.contaminated(runs, bench),
    }[name]
    start = time.time()
    assert make().count() == (0 if name == "decontam" else len(RUNS))
    assert time.time() - start < 120
