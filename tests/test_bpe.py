"""Byte-pair merges by the inverted index against a plain recount."""

import random
from collections import Counter

import pytest

from docloom.operators import bpe, vocab
from docloom.plans import registry, text_queries  # noqa: F401


def plain_merges(words, n):
    """(left, right, freq) of each merge of {word: freq}, counting all pairs again for each."""
    held = {w: [*w, bpe.END] for w in words}
    out = []
    for _ in range(n):
        count = Counter()
        for w, s in held.items():
            for p in zip(s, s[1:]):
                count[p] += words[w]
        if not count:
            break
        (a, b), freq = min(count.items(), key=lambda x: (-x[1], x[0][0].encode(), x[0][1].encode()))
        out.append((a, b, freq))
        for s in held.values():
            k = 0
            while k < len(s) - 1:
                if s[k] == a and s[k + 1] == b:
                    s[k : k + 2] = [a + b]
                k += 1
    return out


def words_of(spark, words):
    return vocab.symbols(spark.createDataFrame(list(words.items()), "word string, freq bigint"))


@pytest.mark.parametrize("passes,top", [(12, 64), (2, 3)])
def test_merges_equal_a_plain_recount(spark, sf, monkeypatch, passes, top):
    monkeypatch.setattr(bpe, "PASSES", passes)
    monkeypatch.setattr(bpe, "TOP", top)
    words = {r["word"]: r["freq"] for r in vocab.word_counts(spark.read.parquet(f"{sf}/documents.parquet"), "text").collect()}
    found, took = bpe.learned(words_of(spark, words), 30)
    assert [tuple(r) for r in found.orderBy("merge_no").select("left", "right", "freq").collect()] == plain_merges(words, 30)
    assert took["passes"] < 30 and took["touched"].select("word").distinct().count() < len(words)


@pytest.mark.parametrize("seed", range(3))
def test_merges_of_few_letters(spark, seed):
    """Many ties, runs of one letter and products that two pairs give."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("aab<") for _ in range(rnd.randint(1, 7))): rnd.randint(1, 3) for _ in range(40)}
    assert vocab.trained_merges(words_of(spark, words), 25) == plain_merges(words, 25)


def test_a_batch_holds_what_one_at_a_time_would_merge():
    ranked = [("a", "b", 9), ("c", "d", 8), ("e", "e", 7), ("f", "g", 6)]
    assert bpe.safe_batch(ranked, set(), False) == ranked[:2]
    assert bpe.safe_batch(ranked[:2] + [("b", "x", 8)], set(), False) == ranked[:1]  # b x and c d tie
    assert bpe.safe_batch(ranked, {"ab"}, False) == ranked[:1]
    assert bpe.safe_batch(ranked[:2], set(), True) == ranked[:1]  # others may tie with the last


def test_no_words_give_no_merges(spark):
    assert vocab.trained_merges(words_of(spark, {"a": 1}).filter("freq > 1"), 3) == []
    assert "bpe_50_merges" in registry.SQL
