"""Stand-ins for models that need weights: deterministic, offline, and replaceable by anything of the same shape."""

from __future__ import annotations

import difflib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

DIM = 64


def hashed_vector(text: str, dim: int = DIM) -> list[float]:
    """A bag of hashed words with signs, of unit length."""
    import re

    v = np.zeros(dim)
    for w in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def encode(text: Column, dim: int = DIM) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: hashed_vector(t, dim))

    return run(text)


def entities(text: Column) -> Column:
    """Runs of capitalised words of more than one letter, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"), F.lit(0)))


def cooccurrences(chunks: DataFrame) -> DataFrame:
    """(chunk, pos, s, r, o, rank): neighbouring entities of a chunk (id, text) as related."""
    found = chunks.select(F.col("id").alias("chunk"), entities(F.col("text")).alias("e")).where(F.size("e") > 1)
    pairs = found.select("chunk", "e", F.posexplode(F.expr("slice(e, 2, size(e) - 1)")).alias("pos", "o"))
    return pairs.select("chunk", "pos", F.col("e")[F.col("pos")].alias("s"), F.lit("occurs with").alias("r"), "o", F.lit(1).alias("rank"))


def summarize(texts: list[str], words: int = 60) -> str:
    """The first words of each text in turn."""
    each = max(1, words // max(1, len(texts)))
    return " ".join(" ".join(t.split()[:each]) for t in texts)


def answer(question: Column, fixed: str = "F") -> Column:
    return F.lit(fixed)


def next_thought(question: Column, passages: Column, thoughts: Column, words: int = 12) -> Column:
    """The start of the first passage that no thought is from yet; an answer once there is none, or after the second thought."""
    starts = F.transform(passages, lambda p: F.array_join(F.slice(T.words(p), 1, words), " "))
    fresh = F.try_element_at(F.filter(starts, lambda s: ~F.array_contains(thoughts, s)), F.lit(1))
    closing = F.concat(F.lit("So the answer is: "), F.coalesce(F.try_element_at(starts, F.lit(1)), question))
    return F.when((F.size(thoughts) >= 2) | fresh.isNull(), closing).otherwise(fresh)


def rerank_score(question: Column, passage: Column) -> Column:
    """The share of the question's words that a passage has."""
    q = F.array_distinct(T.tokens(question))
    return F.size(F.array_intersect(q, T.tokens(passage))) / F.greatest(F.lit(1), F.size(q))


def closest(text: Column, candidates: Column) -> Column:
    """The candidate with the highest matching-blocks ratio, the first of equals."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([max(c, key=lambda x: difflib.SequenceMatcher(None, x, t).ratio()) if t is not None and len(c) else None for t, c in zip(a, b, strict=True)], dtype=object)

    return run(text, candidates)
