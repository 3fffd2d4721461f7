"""Phrase collocations: n-grams counted by word-id suffix arrays of shards, merged by key, scored by their weakest cut."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bound_batches, cut, forget, join_hot

#: A shard holds at most so many words and marks of one language; a task holds at most HELD of all languages.
SHARD, HELD = 1 << 19, 1 << 21
#: Bits of a filter: so many for each key, and so many in all.
BITS_EACH, BITS = 16, 28
#: The best of a language are found in so many parts first.
SALTS = 64
_MARK = 0xFF  # no byte of UTF-8
_TABLE = bytes(_MARK if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words, with a mark wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).replace(b"\xff", b" \xff ").split(b" ")


class _Buffer:
    """The texts of one language as word ids; 0 ends a piece."""

    def __init__(self):
        self.ids, self.parts, self.size = {}, [], 0

    def add(self, text: str) -> int:
        """Words and marks that the text adds."""
        ids = self.ids
        got = np.fromiter((0 if w == b"\xff" else ids.setdefault(w, len(ids) + 1) for w in words_of(text) if w), np.int32)
        if len(got):
            self.parts += [got, np.zeros(1, np.int32)]
            self.size += len(got) + 1
        return len(got) + 1 if len(got) else 0

    def shards(self, lang: str, reach: int):
        """Rows of at most SHARD ids, each with the reach that follow it; their own words and counts."""
        if not self.size:
            return
        all_ids, names = np.concatenate(self.parts), [b"", *self.ids]
        for at in range(0, len(all_ids), SHARD):
            ids, own = all_ids[at : at + SHARD + reach], min(SHARD, len(all_ids) - at)
            counts = np.bincount(ids[:own], minlength=len(names))
            counts[0] = 0
            used = np.flatnonzero(np.bincount(ids, minlength=len(names)))
            used = used[used > 0]
            local = np.zeros(len(names), np.int32)
            local[used] = np.arange(1, len(used) + 1)
            words = pa.array([names[i] for i in used.tolist()], pa.binary()).cast(pa.string())
            row = [pa.array([lang], pa.string()), pa.array([own], pa.int32()), pa.array([local[ids].tobytes()], pa.binary()), pa.ListArray.from_arrays([0, len(used)], words), pa.ListArray.from_arrays([0, len(used)], pa.array(counts[used].astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(row, ["lang", "own", "ids", "words", "counts"])


def _shards(docs: DataFrame, reach: int) -> DataFrame:
    """(shard, lang, own, ids, words, counts): texts as ids of the shard's own words."""

    def run(batches):
        held: dict[str, _Buffer] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buffer = held.get(lang)
                if buffer is None:
                    buffer = held[lang] = _Buffer()
                size += buffer.add(text)
                if buffer.size >= SHARD:
                    yield from buffer.shards(lang, reach)
                    size -= buffer.size
                    del held[lang]
                elif size >= HELD or len(held) > 10_000:
                    for name, each in held.items():
                        yield from each.shards(name, reach)
                    held, size = {}, 0
        for name, each in held.items():
            yield from each.shards(name, reach)

    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "lang string, own int, ids binary, words array<string>, counts array<long>").withColumn("shard", F.monotonically_increasing_id())


def suffix_array(ids: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of ids in order of their first depth ids, by prefix doubling: each round ranks twice the length.

    With at, only the suffixes that start there are ordered.
    """
    n, done = len(ids), 1
    rank, at = ids.astype(np.int64), np.arange(n) if at is None else at
    while done < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - done, 0)] = rank[done:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        done *= 2
        if done >= depth:
            return at[np.argsort(key[at], kind="stable")]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1]))[:n])
    return at[np.argsort(rank[at], kind="stable")]


def intervals(ids: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of every different phrase of k ids among those that start at at.

    The LCP of neighbouring suffixes is what they have in common, up to k; the suffixes of an LCP interval of k are the
    occurrences of one phrase.
    """
    if not len(at):
        return at, at
    wide = np.concatenate((ids, np.zeros(k, ids.dtype)))
    order = suffix_array(ids, k, at)
    lcp, same = np.zeros(len(order) - 1, np.int64), np.ones(len(order) - 1, bool)
    for j in range(k):
        same &= wide[order[1:] + j] == wide[order[:-1] + j]
        lcp += same
    starts = np.flatnonzero(np.concatenate(([True], lcp < k)))
    return order[starts], np.diff(np.append(starts, len(order)))


def _slot(words: list[np.ndarray], bits: int) -> np.ndarray:
    """Where a filter keeps a run of numbers."""
    x = np.zeros(len(words[0]), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            x = (x + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(64 - bits)).astype(np.int64)


def _crc(lang: str, words: list[str]) -> np.ndarray:
    start = zlib.crc32(lang.encode() + b"\n")
    return np.fromiter((zlib.crc32(w.encode(), start) for w in words), np.int64, len(words))


class Filter:
    """A bitmap of frequent keys: it has a bit for each of them and few others.

    It has BITS_EACH bits a key but never more than 2^BITS (32 MB), and so may be broadcast at any size; the fuller it is,
    the more is counted for nothing.
    """

    def __init__(self, keys: DataFrame, numbers):
        """numbers gives the columns of numbers that stand for the rows of a batch of keys."""
        self.bits = bits = min(BITS, max(15, math.ceil(math.log2(max(keys.count(), 1) * BITS_EACH))))

        def slots(batches):
            for batch in batches:
                slot = np.unique(_slot(numbers(batch), bits))
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 15), pa.array((slot & 32767).astype(np.int32))], ["block", "bit"])

        def blocks(batches):
            block, held = None, np.zeros(32768, bool)
            for batch in batches:
                tags, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for tag in np.unique(tags).tolist():
                    if tag != block and block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(held).tobytes()], pa.binary())], ["block", "bits"])
                        held[:] = False
                    block = tag
                    held[bit[tags == tag]] = True
            if block is not None:
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(held).tobytes()], pa.binary())], ["block", "bits"])

        out = np.zeros(1 << bits >> 3, np.uint8)
        found = keys.mapInArrow(slots, "block long, bit int").distinct().repartition("block").sortWithinPartitions("block").mapInArrow(blocks, "block long, bits binary")
        for row in found.toLocalIterator():
            out[row.block << 12 : (row.block + 1) << 12] = np.frombuffer(row.bits, np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(out)

    def test(self):
        """A function of columns of numbers, for tasks."""
        bits, sent = self.bits, self.sent

        def on(words: list[np.ndarray]) -> np.ndarray:
            slot = _slot(words, bits)
            return (sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)

        return on


def _numbered(shards: DataFrame, frequent: DataFrame) -> DataFrame:
    """(own, ids, numbers): the shards with only frequent words as ids 1, 2, …, all others as 0, and the number of each id in frequent."""

    def by_lang(batch):
        langs = batch.column(0).to_pylist()
        return [np.concatenate([_crc(lang, [w]) for lang, w in zip(langs, batch.column(1).to_pylist(), strict=True)] or [np.zeros(0, np.int64)])]

    test = Filter(frequent.select("lang", "word"), by_lang).test()

    def likely(batches):
        for batch in batches:
            for i in range(len(batch)):
                lang, words = batch.column(1)[i].as_py(), batch.column(2)[i].values
                at = np.flatnonzero(test([_crc(lang, words.to_pylist())]))
                for s in range(0, len(at), 50_000):
                    some = pa.array(at[s : s + 50_000].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column(0)[i].as_py())), pa.array([lang] * len(some), pa.string()), some, words.take(some)], ["shard", "lang", "at", "word"])

    at = shards.select("shard", "lang", "words").mapInArrow(likely, "shard long, lang string, at int, word string").join(frequent.select("lang", "word", "id"), ["lang", "word"])
    maps = at.groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("map"))
    joined = shards.select("shard", "own", "ids").join(maps, "shard").select("own", "ids", F.col("map.at").alias("at"), F.col("map.id").alias("id"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids = np.frombuffer(batch.column(1)[i].as_py(), np.int32)
                at, numbers = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
                fresh = np.zeros(max(int(ids.max(initial=0)), int(at.max(initial=0)) + 1) + 1, np.int32)
                fresh[at + 1] = np.arange(1, len(at) + 1)
                out = [batch.column(0).slice(i, 1), pa.array([fresh[ids].tobytes()], pa.binary()), pa.array([np.concatenate(([0], numbers)).astype(np.int64).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["own", "ids", "numbers"])

    return joined.mapInArrow(run, "own int, ids binary, numbers binary")


KEY = ["w1", "w2", "w3", "w4"]


def _grams(numbered: DataFrame, k: int, least: int, filters: list[Filter]) -> DataFrame:
    """(w1, w2, w3, w4, f) of the phrases of k words found at least least times; unused places are 0.

    filters are those of the phrases of 2 to k - 1 words: a phrase is counted where both phrases of one word less are.
    """
    tests = [f.test() for f in filters]

    def run(batches):
        for batch in batches:
            for own, raw, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, numbers = np.frombuffer(raw, np.int32), np.frombuffer(names, np.int64)
                at = np.flatnonzero(ids > 0)
                for size, test in enumerate([None, *tests], 1):  # starts of phrases of size + 1 words whose parts may be frequent
                    fine = np.zeros(len(ids) + 1, bool)
                    fine[at if test is None else at[test([numbers[ids[at + j]] for j in range(size)])]] = True
                    at = np.flatnonzero(fine[:-1] & fine[1:])
                start, counts = intervals(ids, k, at[at < own])
                for s in range(0, len(start), 100_000):
                    some = start[s : s + 100_000]
                    yield pa.RecordBatch.from_arrays([*[pa.array(numbers[ids[some + j]]) for j in range(k)], pa.array(counts[s : s + 100_000])], [*KEY[:k], "c"])

    found = numbered.mapInArrow(run, ", ".join(f"{w} long" for w in KEY[:k]) + ", c long")
    total = found.groupBy(*KEY[:k]).agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    return total.select(*KEY[:k], *[F.lit(0).cast("long").alias(w) for w in KEY[k:]], "f")


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of table, which has one row for each of keys; keys that very many rows share are broadcast."""
    uses = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("uses")).join(table, keys), "uses")
    return join_hot(rows, uses, keys, "uses", uses.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0])


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), with no product cut at 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * F.lit(2_000_000).cast("decimal(7,0)"), wide(l) + wide(r)).cast("long")


def _scored(grams: DataFrame, longest: int) -> DataFrame:
    """KEY, k, a, l, r and score of the lowest-scoring cut of every phrase of two words and more."""
    many = grams.where(F.col("w2") > 0).withColumn("k", F.lit(2) + sum((F.col(w) > 0).cast("int") for w in KEY[2:]))
    word = [F.col(w) for w in KEY] + [F.lit(0).cast("long")] * len(KEY)
    sides = []
    for cut_at in range(1, longest):
        for left in (True, False):
            own = [word[j] if j < cut_at else word[-1] for j in range(len(KEY))] if left else word[cut_at : cut_at + len(KEY)]
            sides.append(F.when(F.col("k") > cut_at, F.struct(F.lit(cut_at).alias("cut"), F.lit(left).alias("left"), *[c.alias(f"p{j}") for j, c in enumerate(own)])))
    part = ["p0", "p1", "p2", "p3"]
    parts = many.select(*KEY, "k", F.col("f").alias("a"), F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("x")).select(*KEY, "k", "a", "x.*")
    found = _looked_up(parts, grams.select(*[F.col(w).alias(p) for w, p in zip(KEY, part, strict=True)], "f"), part)
    f_of = lambda c, left: F.max(F.when((F.col("cut") == c) & (F.col("left") == left), F.col("f")))
    wide = found.groupBy(*KEY, "k", "a").agg(*[f_of(c, left).alias(f"{'l' if left else 'r'}{c}") for c in range(1, longest) for left in (True, False)])
    cuts = [F.when(F.col("k") > c, F.struct(_score(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, longest)]
    return wide.select(*KEY, "k", "a", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("x")).select(*KEY, "k", "a", "x.l", "x.r", "x.score")


def _alone(scored: DataFrame, longest: int, percent: int) -> DataFrame:
    """scored without the phrases inside a longer one that has at least percent of their occurrences."""
    if longest == 2:
        return scored
    word = [F.col(w) for w in KEY] + [F.lit(0).cast("long")] * len(KEY)
    inner = [
        F.when(F.col("k") > size, F.when(F.col("k") >= start + size, F.struct(*[(word[start + j] if j < size else word[-1]).alias(w) for j, w in enumerate(KEY)])))
        for size in range(2, longest) for start in range(longest - size + 1)
    ]
    around = scored.where("k > 2").select("a", F.explode(F.filter(F.array(*inner), lambda x: x.isNotNull())).alias("x")).groupBy("x").agg(F.max("a").alias("most"))
    around = around.select("x.*", "most")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return scored.join(around, KEY, "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * percent)).drop("most")


def mine(docs: DataFrame, longest: int = 4, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first top collocations of every language of docs (text, lang).

    Texts are lower-cased (A-Z), cut at .,;:!? and line ends into pieces and at spaces and tabs into words. n counts a
    language's words, a a phrase's occurrences in pieces, overlaps included. A phrase of 2 to longest words with
    a >= least is a candidate; of its cuts into two parts (l and r occurrences) the one with the lowest
    floor(2000000 a / (l + r)) counts, the first on a tie. Candidates inside a longer candidate with percent of their
    occurrences go. The order is by score, a (falling) and phrase (by UTF-8 bytes).

    Tasks turn their texts into shards of one language: ids of the shard's own words, at most SHARD of them. Word counts
    of all shards give the frequent words; the rest ends a phrase, since none with it can be frequent. Shards learn the
    numbers of their frequent words by a join. Then each shard's suffix array and LCP intervals give its pairs, whose
    counts are added up by key over all shards; likewise phrases of three words both of whose pairs are frequent, and so
    on. Nothing is approximate: a phrase is as frequent as its parts at most, so what is passed over could never be a
    candidate.

    Null texts are empty, null languages are und (with those so named). Repeated rows count each; a language without a
    candidate and an empty table give no rows; texts of any length are cut into shards that overlap by longest - 1 words;
    doc_id and extra columns are not read. longest may be 2 to 4.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shards = cut(_shards(docs, longest - 1), "shards")
    totals = cut(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")), "totals")
    words = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    # in order of frequency, so that most numbers are small
    frequent = cut(words.where(F.col("f") >= least).orderBy(F.desc("f"), "lang", "word").withColumn("id", F.monotonically_increasing_id() + 1), "words")
    numbered = cut(_numbered(shards, frequent), "numbered")
    forget(shards)
    grams = frequent.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in KEY[1:]], "f")
    filters: list[Filter] = []
    for k in range(2, longest + 1):
        found = cut(_grams(numbered, k, least, filters), f"phrases{k}")
        grams = grams.unionByName(found)
        if k < longest:
            filters.append(Filter(found.select(*KEY[:k]), lambda batch: [c.to_numpy() for c in batch.columns]))
    forget(numbered)
    left = cut(_alone(cut(_scored(grams, longest), "scored"), longest, percent), "candidates")
    each = left.select(*KEY, F.posexplode(F.array(*KEY)).alias("at", "id")).where(F.col("id") > 0)
    spelled = _looked_up(each, frequent.select("id", "lang", "word"), ["id"]).groupBy(*KEY, "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = left.join(spelled, KEY).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
