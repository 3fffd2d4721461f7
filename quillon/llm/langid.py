"""Language identification by interpolated Kneser-Ney character models, one a language, in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, WordIndex, bound_batches, cut, forget, sum_runs

#: The longest n-gram, and marks of a word's two ends.
ORDER, START, END = 4, "\x02", "\x03"
#: Languages are modelled and scored together while their n-grams of all orders are at most so many, which bounds what the
#: driver holds and what is broadcast (about 20 bytes each); the others follow in further passes over the texts.
ENTRIES = 1 << 23
#: One in so many teaching texts (by hash) is kept apart for the scores and limits.
APART = 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(unicodedata.normalize("NFC", text or "").lower())


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, given as rows of code points."""
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(points.shape[1]):
            h = (h + points[:, j].astype(np.uint64) + np.uint64(1)) * _GOLD
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _points(grams: list[str]) -> np.ndarray:
    n = len(grams[0])
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, apart, gram, n): how often each language's words show each character after its up to ORDER - 1 predecessors.

    docs: lang, apart (whether a text is kept apart) and text.
    """
    kinds = pa.schema([("lang", pa.string()), ("apart", pa.bool_()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches):
        words: dict[tuple[str, bool], Counter] = {}

        def grams():
            rows: dict[tuple, int] = Counter()
            for key, counts in words.items():
                for word, n in counts.items():
                    if word := _letters(word):
                        marked = START + word + END
                        for i in range(1, len(marked)):
                            rows[*key, marked[max(0, i - ORDER + 1) : i + 1]] += n
            words.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in rows], f.type) for i, f in enumerate(list(kinds)[:3])), pa.array(rows.values(), pa.int64())], schema=kinds)

        for batch in batches:
            for lang, apart, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words.setdefault((lang, apart), Counter()).update(words_of(text))
            if sum(map(len, words.values())) > 200_000:
                yield grams()
        yield grams()

    return docs.select("lang", "apart", "text").mapInArrow(run, "lang string, apart boolean, gram string, n long").groupBy("lang", "apart", "gram").agg(F.sum("n").alias("n"))


class Model:
    """One language's model: for each order, sorted hashes of n-grams with interpolated log probabilities, and of contexts with back-off weights."""

    def __init__(self, levels: list[dict[str, np.ndarray]], alphabet: int):
        """levels[n - 1]: arrays gram, n, context and suffix (hashes) of the n-grams' counts."""
        self.keys, self.logp, self.contexts, self.logw = [], [], [], []
        self.floor = np.float32(0)  # what an unknown character costs at the bottom
        for order, level in enumerate(levels, 1):
            at = np.argsort(level["gram"])
            n = level["n"][at].astype(np.float64)
            above, up, kinds = np.unique(level["context"][at], return_inverse=True, return_counts=True)
            total = np.bincount(up, n, len(above))
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9)
            weight = np.minimum(discount * kinds / np.maximum(total, 1), 1.0)
            lower = np.full(len(n), 1.0 / (alphabet + 1)) if order == 1 else np.exp(self._at(order - 1, level["suffix"][at]))
            self.keys.append(level["gram"][at])
            self.logp.append(np.log(np.maximum(n - discount, 0) / total[up] + weight[up] * lower).astype(np.float32))
            self.contexts.append(above)
            self.logw.append(np.log(weight).astype(np.float32))
            if order == 1 and len(above):
                self.floor = np.float32(self.logw[0][0] - np.log(alphabet + 1))

    @staticmethod
    def _find(keys: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
        return i, keys[i] == hashed

    def _at(self, order: int, gram: np.ndarray) -> np.ndarray:
        i, known = self._find(self.keys[order - 1], gram)
        return np.where(known, self.logp[order - 1][i], self.floor)

    def score(self, size: int, orders: list[tuple]) -> np.ndarray:
        """Log probabilities of size events; orders: for each order, which events have so long a past, and their n-grams' and contexts' hashes."""
        out = np.full(size, self.floor, np.float64)
        for order, (on, gram, context) in enumerate(orders, 1):
            if not len(on) or not len(self.keys[order - 1]):
                continue
            back = out[on]
            if order > 1:
                i, known = self._find(self.contexts[order - 1], context)
                back = back + np.where(known, self.logw[order - 1][i], 0)
            i, known = self._find(self.keys[order - 1], gram)
            out[on] = np.where(known, self.logp[order - 1][i], back)
        return out


class Models:
    """The models of some languages."""

    def __init__(self, langs: list[str], models: list[Model]):
        self.langs, self.models = langs, models

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word under each language, and its events (letters and the end)."""
        clean = [_letters(w) for w in words]
        sizes = np.array([len(w) + 1 if w else 0 for w in clean], np.int64)
        flat = np.frombuffer("".join(START * (ORDER - 1) + w + END for w in clean if w).encode("utf-32-le", "surrogatepass"), np.uint32)
        real = sizes[sizes > 0]
        own = np.arange(real.sum()) + np.repeat(np.arange(1, len(real) + 1) * (ORDER - 1), real)  # where the events are
        past = np.arange(real.sum()) - np.repeat(np.cumsum(real) - real, real) + 1  # characters before each, with one start
        # events with the same past (as much of it as counts) are scored once
        points = flat[own[:, None] + np.arange(1 - ORDER, 1)]
        points[np.arange(ORDER - 1, -1, -1)[None, :] > past[:, None]] = 0
        _, some, every = np.unique(hashes(points), return_index=True, return_inverse=True)
        points, past = points[some], past[some]
        orders = []
        for order in range(1, ORDER + 1):
            on = np.flatnonzero(past >= order - 1)
            own = points[on, ORDER - order :]
            orders.append((on, hashes(own), hashes(own[:, :-1])))
        out = np.stack([m.score(len(some), orders) for m in self.models], axis=1) if self.models else np.zeros((len(some), 0))
        return sum_runs(out[every], sizes), sizes


def fit(counts: DataFrame) -> list[Models]:
    """Models from all n-grams counted (lang, gram, n), in blocks of languages. Counts of every order are made by Spark."""
    letters = counts.select(F.substring("gram", -1, 1)).distinct().count()

    def hashed(batches):
        for batch in batches:
            if grams := batch.column(1).to_pylist():
                points = _points(grams)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(hashes(x)) for x in (points, points[:, :-1], points[:, 1:])), batch.column(2)], ["lang", "gram", "context", "suffix", "n"])

    levels = [counts.where(F.length("gram") == ORDER).select("lang", "gram", "n")]
    for order in range(ORDER - 1, 0, -1):  # below the top, a gram counts the different characters it follows, but at a word's start its uses
        follows = levels[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, cut(follows.unionByName(counts.where(F.length("gram") == order).select("lang", "gram", "n")), f"grams{order}"))
    sizes = {r.lang: r.n for r in reduce(DataFrame.unionByName, levels).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    blocks: list[list[str]] = []
    room = 0
    for lang in sorted(sizes):
        if sizes[lang] > room:
            blocks.append([])
            room = ENTRIES
        blocks[-1].append(lang)
        room -= sizes[lang]
    out = []
    for langs in blocks:
        tables = [level.where(F.col("lang").isin(langs)).mapInArrow(hashed, "lang string, gram long, context long, suffix long, n long").toArrow() for level in levels]
        own = []
        for lang in langs:
            rows = [t.filter(pc.equal(t["lang"], lang)) for t in tables]
            own.append(Model([{c: t[c].to_numpy() for c in ("gram", "n", "context", "suffix")} for t in rows], letters))
        out.append(Models(langs, own))
    forget(*levels)
    return out


def entropies(docs: DataFrame, blocks: list[Models]) -> DataFrame:
    """docs' row (a struct of all its columns), best (language), own and next (its and the second best's nats an event), events.

    best is null without letters. The whole text is carried along, so nothing has to be joined to it; each block of
    models is a pass over the texts, which keeps the best of all so far.
    """
    bound_batches(docs.sparkSession)
    none = F.lit(None)
    rows = docs.select(F.struct("*").alias("row"), none.cast("string").alias("best"), none.cast("double").alias("own"), none.cast("double").alias("next"), F.lit(0).cast("long").alias("events"))
    for models in blocks:
        rows = _scored(rows, models)
    return rows.withColumn("next", F.coalesce("next", F.col("own") + 1))


def _scored(rows: DataFrame, models: Models) -> DataFrame:
    shared, width = rows.sparkSession.sparkContext.broadcast(models), len(models.langs)

    def run(batches):
        models, words = shared.value, WordIndex()
        scores, sizes = np.zeros((0, width)), np.zeros(0, np.int64)
        for batch in batches:
            split = [words_of(t) for t in batch.column("row").field("text").to_pylist()]
            n = words.numbers([w for own in split for w in own])
            if words.fresh:
                more = models.score(words.fresh)
                scores, sizes = np.concatenate((scores, more[0])), np.concatenate((sizes, more[1]))
                words.fresh.clear()
            lengths = np.array([len(x) for x in split], np.int64)
            events = sum_runs(sizes[n], lengths).astype(np.int64)
            each = -sum_runs(scores[n], lengths) / np.maximum(events, 1)[:, None]
            before = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("own", "next")]
            each = np.column_stack((*(np.where(np.isnan(x), np.inf, x) for x in before), each))  # of equals, the first language counts
            order = np.argsort(each, axis=1, kind="stable")
            two = np.take_along_axis(each, order[:, :2], 1)
            best = [None if not e else old if i == 0 else models.langs[i - 2] for i, e, old in zip(order[:, 0], events, batch.column("best").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best, pa.string()), *(pa.array(x, mask=np.isinf(x)) for x in two.T), pa.array(events)], names)
            if words.full:
                words.clear()
                scores, sizes = scores[:0], sizes[:0]

    names = rows.columns
    return rows.mapInArrow(run, rows.schema)


def _bin() -> Column:
    return F.least(F.lit(63), F.floor(F.log2(1 + (F.col("next") - F.col("own")) * F.col("events")) * 4)).cast("int")


def identify(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """docs with held_out, lang_pred, score and rejected; columns of these names are replaced.

    train says which rows may teach (by default those whose crc32(doc_id) mod 5 is not 0); of these, text and non-null
    lang do. The prediction is the language with the lowest cross-entropy a character over the whole text. score is how
    often predictions with such a lead over the second language are right (smoothed, never falling with the lead).
    rejected: no prediction, or a cross-entropy over the limit of its language, which is the mean of the language's texts
    plus six deviations, or halfway to what characters drawn evenly would have if that is more, with four standard errors
    of slack for short texts. Scores and limits come from teaching texts kept apart, one in APART by a hash of the text
    (so copies stay together), under models that the others taught; the models that predict are taught by all.

    Null texts and texts without a letter get und, score 0 and rejected. Without a teaching row all do. Repeated rows
    count as often as they occur and are scored alike. A null doc_id is hashed as an empty one. Other columns, of any
    name, pass through. An empty table gives an empty one.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    teaches = F.coalesce(train, F.lit(False)) if train is not None else rest != 0
    bound_batches(docs.sparkSession)
    taught = docs.where(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    taught = taught.withColumn("apart", F.pmod(F.xxhash64("text"), F.lit(APART)) == 0)
    counts = cut(gram_counts(taught), "grams")
    probe = fit(counts.where(~F.col("apart")))
    models = fit(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    apart = entropies(taught.where("apart"), probe).select(F.col("row.lang").alias("lang"), "best", "own", "next", "events").where(F.col("best").isNotNull())
    apart = cut(apart, "apart")
    forget(counts)
    right = F.col("lang") == F.col("best")
    bins = {r.bin: (r.hits, r.n) for r in apart.groupBy(_bin().alias("bin")).agg(F.sum(right.cast("int")).alias("hits"), F.count(F.lit(1)).alias("n")).collect()}
    curve, top = [], 0.5
    for b in range(64):
        hits, n = bins.get(b, (0, 0))
        top = max(top, (hits + 1) / (n + 2)) if n else top
        curve.append(top)
    spread = F.sqrt(F.avg(F.col("own") ** 2 * F.col("events")) - 2 * F.avg("own") * F.avg(F.col("own") * F.col("events")) + F.avg("own") ** 2 * F.avg("events"))
    limits, floors = [], {lang: float(-m.floor) for block in models for lang, m in zip(block.langs, block.models, strict=True)}
    for r in apart.where(right).groupBy("best").agg(F.avg("own").alias("mean"), F.stddev_pop("own").alias("dev"), spread.alias("spread")).collect():
        limits.append((r.best, r.mean + max(6 * (r.dev or 0.0), (floors[r.best] - r.mean) / 2), 0.0 if r.spread is None or r.spread != r.spread else float(r.spread)))
    forget(apart)
    table = docs.sparkSession.createDataFrame(limits, "best string, most double, spread double")  # a row a language
    scores = F.element_at(F.array(*[F.lit(x) for x in curve]), _bin() + 1)
    over = F.coalesce(F.col("own") > F.col("most") + 4 * F.col("spread") / F.sqrt("events"), F.lit(False))
    new = {"lang_pred": F.coalesce("best", F.lit("und")), "score": F.when(F.col("best").isNull(), 0.0).otherwise(scores), "rejected": F.col("best").isNull() | over}
    own = entropies(docs.drop("held_out", *new), models).join(F.broadcast(table), "best", "left")
    return own.select("row.*", *[c.alias(name) for name, c in new.items()]).withColumn("held_out", ~teaches)
