"""Token counts of a unigram tokenizer without its tokens: a Viterbi pass that carries best score and piece count."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIndex, bound_batches, sum_runs
from .packing import _ODD, _SPACE

#: An unknown character scores so much below the worst piece.
UNKNOWN = 10.0


def vocabulary(model: str) -> list[tuple[str, float]]:
    """A unigram vocabulary from a public piece model: its pieces in their order, with log probabilities by Zipf's law."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    total = math.log(sum(1 / (i + 1) for i in range(len(sp))))
    return [(sp.id_to_piece(i), -math.log(i + 1) - total) for i in range(len(sp))]


class Counter:
    """Counts pieces of words exactly as a unigram model with byte fallback cuts them.

    The automaton enumerates every vocabulary match by its end. At each end the best score wins and, of equal scores,
    the match that starts first (a later one must be better to replace it). A character that no one-character piece
    covers may also be unknown; unknown characters count as their UTF-8 bytes, or one for each run where the vocabulary
    has no piece for one of the run's bytes.
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.match = ahocorasick.Automaton()
        self.pieces: dict[str, float] = {}
        for piece, score in vocab:
            self.pieces[piece] = score
            if piece:
                self.match.add_word(piece, (len(piece), score))
        self.match.make_automaton()
        self.unknown = min(self.pieces.values()) - UNKNOWN
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in self.pieces}

    def count(self, word: str) -> int:
        size = len(word)
        best = [-math.inf] * (size + 1)
        best[0] = 0.0
        pieces, run = [0] * (size + 1), [0] * (size + 1)  # run: of how many unknown characters the last run here is
        size_, unknown, of = size, self.unknown, self.pieces
        done = 0
        pending: list = []

        def settle(end: int) -> None:
            top, n, open_, single = -math.inf, 0, 0, False
            for length, score in sorted(pending, reverse=True):
                single = single or length == 1
                if best[end - length] + score > top:
                    top, n, open_ = best[end - length] + score, pieces[end - length] + 1, 0
            if not single and best[end - 1] + unknown > top:
                top, open_ = best[end - 1] + unknown, run[end - 1] + 1
                n = pieces[end - open_] + self._fallback(word[end - open_ : end])
            best[end], pieces[end], run[end] = top, n, open_
            pending.clear()

        for last, found in self.match.iter(word):
            while done < last:
                done += 1
                settle(done)
            pending.append(found)
        while done < size_:
            done += 1
            settle(done)
        return pieces[size]

    def of_word(self, word: str) -> int:
        """A word begins with a space mark, and is cut before any that it holds."""
        return sum(map(self.count, re.findall("▁[^▁]*", word if word.startswith("▁") else "▁" + word)))

    def _fallback(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        return len(raw) if self.bytes.issuperset(raw) else 1


def count_tokens(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """docs' doc_id and n_tokens: the pieces of the whole text, words being split at white space and each begun by a space mark.

    Every piece of the vocabulary matches in plain text, also those written like controls or bytes ("<s>", "<0x41>"), as in
    the libraries' unigram models, to which pieces are strings. Null and empty texts have none. Repeated rows and ids give a row each; extra columns are not read. Words are counted
    once for each worker and then looked up; the lookup is bounded and emptied when full.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        counter, words, counts = Counter(vocabulary(model)), WordIndex(), np.zeros(0, np.int64)
        for batch in batches:
            split = [[w for w in _SPACE.split(t) if w] if _ODD.search(t) else t.split() for t in (x or "" for x in batch.column(1).to_pylist())]
            n = words.numbers([w for own in split for w in own])
            counts = np.concatenate((counts, np.fromiter(map(counter.of_word, words.fresh), np.int64, len(words.fresh))))
            words.fresh.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sum_runs(counts[n], np.array([len(x) for x in split], np.int64)).astype(np.int64))], ["doc_id", "n_tokens"])
            if words.full:
                words.clear()
                counts = counts[:0]

    return docs.select(F.col("doc_id").cast("long"), F.col(column).cast("string")).mapInArrow(run, "doc_id long, n_tokens long")
