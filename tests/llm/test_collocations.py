"""Collocations against a count of every phrase; suffix arrays and LCP intervals against slices."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import collocations


def brute(rows, longest=4, least=30, percent=80, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    many = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in many.items():
        cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        longer = [b for (other, v), b in many.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * b >= percent * a for b in longer):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    rank, found = Counter(), []
    for lang, score, a, phrase, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            found.append((lang, rank[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return found


def corpus(seed=1, rows=60):
    rng = np.random.default_rng(seed)
    vocab = ["The", "of", "é", "İ", "ß", "a", "\x01", "\xa0x", "no-break", "𐐀", *("w%d" % i for i in range(12))]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", "\x0b", "\x0c", " ; ", ":"]
    texts = []
    for i in range(rows):
        words = rng.choice(vocab, int(rng.integers(0, 150)), p=np.arange(len(vocab), 0, -1) / sum(range(len(vocab) + 1)))
        text = "".join(w + marks[int(rng.integers(len(marks)))] for w in words) + " New York City Hall " * int(rng.integers(0, 4))
        texts.append((text, [None, "en", "und", "de"][i % 4]))
    return [*texts, (None, "en"), ("", "xx"), (" . ", None), *texts[:3], ("x y " * 40, "only"), ("one two three four five " * 31, "tie")]


@pytest.mark.parametrize(("least", "top", "longest", "shard"), [(30, 2000, 4, None), (8, 5, 4, 64), (8, 2000, 3, 64), (8, 2000, 2, 1000)])
def test_mine(spark, monkeypatch, least, top, longest, shard):
    if shard:
        monkeypatch.setattr(collocations, "SHARD", shard)
        monkeypatch.setattr(collocations, "HELD", shard * 3)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "text string, lang string, a int, n int, phrase string").repartition(3)
    found = collocations.mine(df, longest=longest, least=least, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, longest, least, top=top))


def test_nothing_to_mine(spark):
    df = spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")
    assert collocations.mine(df).count() == 0 and collocations.mine(df.limit(0)).count() == 0


def test_filter_only_saves_work(spark, monkeypatch):
    """A filter that passes everything, as one that is full would, gives the same result."""
    rows = corpus(2, 40)
    df = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(brute(rows, least=5))
    assert sorted(map(tuple, collocations.mine(df, least=5).collect())) == want
    monkeypatch.setattr(collocations.Filter, "test", lambda self: lambda words: np.ones(len(words[0]), bool))
    assert sorted(map(tuple, collocations.mine(df, least=5).collect())) == want


def test_wide_products(spark):
    row = spark.range(1).select(collocations._score(F.lit(9 * 10**17), F.lit(9 * 10**18), F.lit(9 * 10**18 + 7)).alias("s")).first()
    assert row.s == 2000000 * 9 * 10**17 // (9 * 10**18 + 9 * 10**18 + 7)


def test_suffix_array_and_intervals():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 300):
        ids = rng.integers(0, 4, n).astype(np.int32)
        for depth in (1, 2, 3, 4, 8):
            order = collocations.suffix_array(ids, depth)
            keys = [tuple(ids[i : i + depth]) for i in order]
            assert sorted(order) == list(range(n)) and keys == sorted(keys)
            some = np.flatnonzero(rng.random(n) < 0.5)
            part = collocations.suffix_array(ids, depth, some)
            assert sorted(part) == sorted(some) and [tuple(ids[i : i + depth]) for i in part] == sorted(tuple(ids[i : i + depth]) for i in some)
        for k in (2, 3, 4):
            at = np.flatnonzero((ids > 0) & (np.arange(n) <= n - k))
            first, counts = collocations.intervals(ids, k, at)
            want = Counter(tuple(ids[i : i + k]) for i in at)
            assert {tuple(ids[i : i + k]): c for i, c in zip(first, counts)} == want and len(first) == len(want)
