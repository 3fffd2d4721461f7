"""Judging answers: correctness, exact match, F1, ROUGE-L, recall and grounding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T

#: A proof of so many words or more is grounded by any so many in a row; a shorter one only as a whole.
GRAM = 8


def _low(c: Column) -> Column:
    return F.lower(F.trim(c))


def correctness(answer: Column, correct: Column, labels: Column | None = None, choices: Column | None = None) -> Column:
    """correct, wrong or formatting_error. labels and choices are arrays of a multiple-choice question."""
    said, right = _low(answer), _low(correct)
    if labels is None or choices is None:
        return F.when(said == right, "correct").otherwise("formatting_error")
    pairs = F.arrays_zip(labels.alias("l"), choices.alias("c"))
    text = F.try_element_at(F.filter(pairs, lambda p: _low(p["l"]) == right), F.lit(1))["c"]
    known = F.exists(pairs, lambda p: (_low(p["l"]) == said) | (_low(p["c"]) == said))
    return F.when(said == right, "correct").when(F.coalesce(_low(text) == said, F.lit(False)), "correct").when(F.coalesce(known, F.lit(False)), "wrong").otherwise("formatting_error")


def exact_match(answer: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: T.normalized_answer(g) == T.normalized_answer(answer)).cast("double")


def token_f1(answer: Column, golds: Column) -> Column:
    """The best F1 over golds of normalised words, counted as often as they occur."""
    own = T.words(T.normalized_answer(answer))

    def one(gold: Column) -> Column:
        words = T.words(T.normalized_answer(gold))
        both = F.aggregate(F.array_distinct(own), F.lit(0), lambda a, w: a + F.least(F.size(F.filter(own, lambda x: x == w)), F.size(F.filter(words, lambda x: x == w))))
        return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(own) + F.size(words)))

    return F.array_max(F.transform(golds, one))


def pooled_recall(found: Column, golds: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(found, 1, k), golds)) / F.size(F.array_distinct(golds))


def stem(word: str) -> str:
    """Porter's stemmer, first published in Program 14(3), 1980."""
    import re

    if len(word) <= 3:
        return word
    c, v = "[^aeiou](?:[^aeiouy]*)", "[aeiouy][aeiou]*"
    more = lambda s, n: re.match(f"^(?:{c})?(?:{v}{c}){{{n},}}(?:{v})?$", s) is not None and len(s) > 0
    vowel = lambda s: re.search(f"^(?:{c})?{v}", s) is not None
    cvc = lambda s: re.search(f"^{c}{v}[^aeiouwxy]$", s) is not None
    w = re.sub(r"(ss|i)es$", r"\1", word)
    w = w if w != word else re.sub(r"([^s])s$", r"\1", word)
    if w.endswith("eed"):
        w = w[:-1] if more(w[:-3], 1) else w
    elif m := re.match(r"^(.+?)(ed|ing)$", w):
        if vowel(m[1]):
            w = m[1]
            if re.search("(at|bl|iz)$", w) or cvc(w):
                w += "e"
            elif re.search(r"([^aeiouylsz])\1$", w):
                w = w[:-1]
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffixes of steps 2, 3 and 4.
    two = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
    three = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    four = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
    for table in (two, three):
        for s in sorted(table, key=len, reverse=True):
            if w.endswith(s):
                w = w[: -len(s)] + table[s] if more(w[: -len(s)], 1) else w
                break
    for s in sorted([*four, "ion"], key=len, reverse=True):
        if w.endswith(s):
            root = w[: -len(s)]
            w = root if more(root, 2) and (s != "ion" or root.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (more(w[:-1], 2) or more(w[:-1], 1) and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and more(w[:-1], 2) else w


def rouge_l_score(answer: str, reference: str) -> float:
    """F measure of the longest common subsequence of stemmed words."""
    import re

    a, b = ([stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())] for t in (answer, reference))
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    both = len(a) - row.bit_count()
    return 2 * both / (len(a) + len(b))


def rouge_l(answer: Column, reference: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([rouge_l_score(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return run(answer, reference)


def grams(words: Column, n: int = GRAM) -> Column:
    """All runs of n words, each once."""
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def ground_proofs(proofs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(proof_id, rank): the best-ranked chunk (question_id, rank, text) of each proof's question (proof_id, question_id, proof) that grounds it, else -1.

    Long proofs meet chunks on shared runs of words, short ones on runs of their own length; no proof is compared with
    every chunk.
    """
    own = proofs.select("proof_id", "question_id", T.words(F.col("proof")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(GRAM)).alias("n")
    sizes = [r.n for r in own.select(size).distinct().collect()]  # at most GRAM numbers
    text = chunks.select("question_id", "rank", T.words(F.col("text")).alias("w"))
    found = None
    for n in sizes:
        p = own.where(F.least(F.size("w"), F.lit(GRAM)) == n).select("proof_id", "question_id", F.explode(grams(F.col("w"), n)).alias("g"))
        c = text.select("question_id", "rank", F.explode(grams(F.col("w"), n)).alias("g"))
        part = p.join(c, ["question_id", "g"]).groupBy("proof_id").agg(F.min("rank").alias("rank"))
        found = part if found is None else found.unionByName(part)
    ids = proofs.select("proof_id")
    return ids.withColumn("rank", F.lit(-1)) if found is None else ids.join(found, "proof_id", "left").fillna({"rank": -1})
