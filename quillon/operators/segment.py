"""Cutting documents into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vectors as V


def chunk_name(doc: Column, number: Column) -> Column:
    return F.concat(doc.cast("string"), F.format_string("_%04d", number))


def word_chunks(docs: DataFrame, size: int = 1200) -> DataFrame:
    """(doc_id, chunk_id, chunk_no, text): size words each, the last may have fewer; documents without words have none."""
    cut = F.regexp_extract_all("text", F.lit(rf"\S++(?:\s++\S++){{0,{size - 1}}}+"), F.lit(0))  # one pass over the text, no words are held
    pieces = docs.select("doc_id", F.posexplode(cut).alias("chunk_no", "text"))
    return pieces.select("doc_id", chunk_name(F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"), "chunk_no", F.regexp_replace("text", r"\s+", " ").alias("text"))


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def _fold(make: Callable[[str], list[str]], docs: DataFrame) -> DataFrame:
    """One pass of a sequential chunker over each document; documents are independent, so nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, f"{d}_{i:04d}", i, c) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, c in enumerate(make(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "chunk_no", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_id string, chunk_no int, text string")


def split_sentences(text: str) -> list[str]:
    import re

    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)) if s]


def contextual_chunks(docs: DataFrame, target: int = 1200, least: int = 1100, most: int = 1300, overlap: int = 100) -> DataFrame:
    """Chunks of whole sentences; a token is a white-space-separated word.

    A sentence of more than most tokens is cut to most and stands alone, and what was gathered before it is lost. A chunk
    that ends below target repeats the tail of its last sentence; a short last chunk begins with the tail of the chunk
    before it if that fits.
    """
    if not 0 < least <= target <= most or overlap >= least:
        raise ValueError("needs 0 < least <= target <= most and overlap < least")

    def make(text: str) -> list[str]:
        done: list[str] = []
        held: list[str] = []
        size = 0
        for sentence in split_sentences(text):
            words = sentence.split()
            if len(words) > most:
                done.append(" ".join(words[:most]))
                held, size = [], 0
            elif size + len(words) > most:
                if size < target and held:
                    held.append(" ".join(held[-1].split()[-overlap:]))
                done.append(" ".join(held))
                held, size = [sentence], len(words)
            else:
                held.append(sentence)
                size += len(words)
        if held:
            if size < least and done:
                tail = done[-1].split()[-overlap:]
                if size + len(tail) <= most:
                    held.insert(0, " ".join(tail))
            done.append(" ".join(held))
        return [c for c in done if c.strip()]

    return _fold(make, docs)


def token_splits(docs: DataFrame, most: int = 100, overlap: int = 0) -> DataFrame:
    """Chunks of whole sentences (also split at line ends) of at most most words; over-long sentences are split at , ; and :, then kept as they are."""
    import re

    def make(text: str) -> list[str]:
        done: list[str] = []
        held: list[str] = []
        size = 0
        for sentence in (s.strip() for s in re.split(r"[.!?\n]", text)):
            parts = [sentence] if len(sentence.split()) <= most else [p.strip() for p in re.split(r"[,;:]", sentence)]
            for part in filter(None, parts):
                n = len(part.split())
                if held and size + n > most:
                    done.append(" ".join(held))
                    kept: list[str] = []
                    while held and sum(len(h.split()) for h in kept) + len(held[-1].split()) <= overlap:
                        kept.insert(0, held.pop())
                    held, size = kept, sum(len(k.split()) for k in kept)
                held.append(part)
                size += n
        return [*done, " ".join(held)] if held else done

    return _fold(make, docs)


def token_windows(docs: DataFrame, size: int = 512) -> DataFrame:
    """(doc_id, window_no, n_tokens): non-overlapping windows of tokens."""
    own = docs.select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    starts = own.select("doc_id", "t", F.posexplode(F.expr(f"sequence(1, size(t), {size})")).alias("window_no", "at"))
    return starts.select("doc_id", "window_no", F.size(F.slice("t", F.col("at"), size)).alias("n_tokens"))


def semantic_breaks(vectors: DataFrame, group: str, order: str, vector: str, share: float = 0.95) -> DataFrame:
    """vectors with gap (cosine distance to the one before in its group) and segment (breaks are gaps over the group's percentile)."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    gaps = vectors.withColumn("_before", F.lag(vector).over(w)).withColumn("gap", F.when(F.col("_before").isNotNull(), V.distance("cosine", F.col("_before"), F.col(vector)))).drop("_before")
    limit = gaps.withColumn("limit", F.percentile("gap", F.lit(share)).over(Window.partitionBy(group)))
    return limit.withColumn("segment", F.sum(F.coalesce(F.col("gap") > F.col("limit"), F.lit(False)).cast("int")).over(w))


def rebuilt(chunks: DataFrame) -> DataFrame:
    """(doc_id, text): chunks joined in the order of their names."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", "text")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
