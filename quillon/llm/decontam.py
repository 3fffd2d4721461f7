"""Benchmark decontamination by latent semantic retrieval: a randomised SVD of TF-IDF passages, then exact checks."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, bound_batches, cut

#: Documents are encoded over the words of so many benchmark items as have at most VOCABULARY different ones, which bounds
#: what is broadcast; the search then takes ITEMS of them at a time.
VOCABULARY, ITEMS = 1_000_000, 2000
#: Words of a passage in the matrix, latent dimensions, and how many more the range finder carries.
PASSAGE, RANK, EXTRA = 64, 32, 8
#: Besides what an item may miss, so large a part of its words (and at least two) counts among its rare ones, see Rare.
SPARE = 0.3
#: Items of fewer words have no paraphrases, see find_leaks; and so much of an item's weight lies in its rare words.
PARAPHRASED, HEAVY = 12, 0.8
#: Window lengths for items grow by this factor; windows start every half of their length, or more often.
GROWTH = 1.5
#: Numbers of matrix entries and of words that are worked on at a time.
ENTRIES, LINE = 200_000, 150_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def answer_of(text: str) -> list[str]:
    """An item's answer: the words after its last question mark or colon, else of its last sentence."""
    tail = re.split(r"[?:]", text.strip())[-1]
    parts = [p for p in re.split(r"(?<=[.!?])\s+", tail.strip()) if words_of(p)]
    return words_of(parts[-1]) if parts else []


class Items:
    """Benchmark items over their own terms, which others number in the table terms."""

    def __init__(self, rows: list[tuple[int, list[int], list[int]]]):
        """rows: item_id, words and answer by their numbers elsewhere."""
        self.terms, words = np.unique(np.concatenate([np.array(w, np.int64) for _, w, _ in rows]), return_inverse=True)
        self.ids = [i for i, _, _ in rows]
        self.words = np.split(words, np.cumsum([len(w) for _, w, _ in rows])[:-1])
        self.answers = [np.searchsorted(self.terms, a).tolist() for _, _, a in rows]
        lengths = defaultdict(list)
        for i, own in enumerate(self.words):
            size = 8.0
            while size < len(own):
                size *= GROWTH
            lengths[int(size)].append(i)
        self.windows = dict(lengths)

    def local(self, width: int) -> np.ndarray:
        """From numbers in a table of width terms to this block's, -1 for terms it does not have."""
        out = np.full(width, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out


def encode(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, n_words, places, terms): where each document has these terms, as little-endian int32."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        get = shared.value.get
        for batch in batches:
            out = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(ids >= 0).astype(np.int32)
                for column, v in zip(out, (doc, len(words), at.tobytes(), ids[at].tobytes()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_words", "places", "terms"), out, strict=True)), schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.binary()), ("terms", pa.binary())]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, places binary, terms binary")


def _passages(batch: pa.RecordBatch, local: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage, term) of every occurrence, passages numbered within the batch, and how many there are; terms as local has them."""
    sizes = batch.column("n_words").to_numpy()
    tiles = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(tiles) - tiles
    places = [np.frombuffer(x, np.int32) for x in batch.column("places").to_pylist()]
    terms = [np.frombuffer(x, np.int32) for x in batch.column("terms").to_pylist()]
    counts = np.array([len(x) for x in places], np.int64)
    at = np.concatenate(places).astype(np.int64) // PASSAGE + np.repeat(first, counts) if len(places) else np.zeros(0, np.int64)
    terms = np.concatenate(terms).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
    if local is not None:
        terms = local[terms].astype(np.int64)
        at, terms = at[terms >= 0], terms[terms >= 0]
    return at, terms, int(tiles.sum())


def frequencies(encoded: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """How many passages there are, and in how many each term is."""

    def run(batches):
        found, total = np.zeros(width, np.int64), 0
        for batch in batches:
            at, terms, n = _passages(batch)
            key = np.sort(at * width + terms)
            found += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] % width, minlength=width)
            total += n
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some))), pa.array(np.concatenate(([total], found[some])))], ["term", "n"])

    counts = np.zeros(width + 1, np.int64)
    rows = encoded.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    counts[rows["term"].to_numpy() + 1] = rows["n"].to_numpy()
    return int(counts[0]), counts[1:]


def sum_rows(values: np.ndarray, at: np.ndarray, weights: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
    """Sums of values[at] (times weights, a column) over the runs that begin at starts, none of them empty.

    The first rows of all runs are added up, then the second ones and so on, which takes a third of the time of reduceat
    along the first axis. Runs of more than PASSAGE rows are summed in parts of so many.
    """
    parts = -(-np.diff(starts, append=len(at)) // PASSAGE)
    first = np.cumsum(parts) - parts
    begin = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(first, parts)) * PASSAGE
    lengths = np.diff(begin, append=len(at))
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], begin[order]
    sums = np.zeros((len(begin), values.shape[1]), np.float32)
    for k in range(int(lengths[0]) if len(lengths) else 0):
        i = begin[: np.searchsorted(-lengths, -k)] + k
        sums[: len(i)] += values[at[i]] if weights is None else values[at[i]] * weights[i]
    out = np.empty_like(sums)
    out[order] = sums
    return out if len(first) == len(out) else np.add.reduceat(out, first, axis=0)


def _gram(encoded: DataFrame, local: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """AᵀA basis, A being the TF-IDF passages: one pass, partial sums by task, then sums by term.

    A passage is scaled by the root of the summed squares of its words' weights, a word counting as often as it occurs.
    """
    spark, (width, rank) = encoded.sparkSession, basis.shape
    shared = spark.sparkContext.broadcast((local, weights, basis.astype(np.float32)))

    def run(batches):
        local, weights, basis = shared.value
        out = np.zeros((width, rank))
        for batch in batches:
            at, terms, n = _passages(batch, local)
            if not len(at):
                continue
            v = weights[terms]
            v = (v / np.sqrt(np.bincount(at, v * v, minlength=n))[at]).astype(np.float32)
            a = 0
            while a < len(at):  # whole passages
                b = len(at) if a + ENTRIES >= len(at) else int(np.searchsorted(at, at[a + ENTRIES], "right"))
                t, w = terms[a:b], v[a:b, None]
                starts = np.flatnonzero(np.concatenate(([True], at[a + 1 : b] != at[a : b - 1])))
                y = sum_rows(basis, t, w, starts)
                order = np.argsort(t.astype(np.uint16) if width <= 1 << 16 else t, kind="stable")
                own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, b - a)))[order]
                t = t[order]
                starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                out[t[starts]] += sum_rows(y, own, w[order], starts)
                a = b
        some = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(out[some, j]) for j in range(rank))], ["term", *(f"v{j}" for j in range(rank))])

    columns = [f"v{j}" for j in range(rank)]
    rows = encoded.mapInArrow(run, "term long, " + ", ".join(f"{c} double" for c in columns)).groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((width, rank))
    if rows.num_rows:
        out[rows["term"].to_numpy()] = np.stack([rows[c].to_numpy() for c in columns], axis=1)
    return out


def latent(encoded: DataFrame, local: np.ndarray, weights: np.ndarray, rank: int = RANK, seed: int = 8) -> np.ndarray:
    """The leading right singular vectors of the passage matrix, by a randomised range finder with one power step."""
    width = len(weights)
    size = min(width, rank + EXTRA)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    basis = np.linalg.qr(_gram(encoded, local, weights, basis))[0]
    small = basis.T @ _gram(encoded, local, weights, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[:rank]]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        if m := masks.get(y):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _holds(region: list[int], answer: list[int]) -> bool:
    """Whether region has answer in one run."""
    n = len(answer)
    return any(region[i : i + n] == answer for i in range(len(region) - n + 1))


def grid(size: int) -> tuple[int, int, int]:
    """(step, before, cells) of windows of this length: they start every step words (a power of two); their regions, from half a window before to half a window after, start at most so many cells of a step before and touch at most so many."""
    step = 1 << (max(1, size // 2).bit_length() - 1)
    before = -(-(size // 2) // step)
    return step, before, (2 * size - size // 2 - 1) // step + before + 1


class Rare:
    """What every region that holds an item of a window length must have, whatever the latent space says of it.

    A region with the share similarity of an item's n words lacks at most n - similarity n of them, so it has all but as
    many of the item's rare ones, which are its rarest words until they are that many and SPARE more. If only the share
    loose is there, the answer stands in one run, so its first three words do.

    The rare words also carry at least HEAVY of an item's weight, so a region with the part of that weight that a
    paraphrase needs has all of it but the rest in them.
    """

    def __init__(self, items: Items, members: list[int], passages: np.ndarray, weights: np.ndarray, similarity: float, loose: float, part: float):
        terms, owners, times, heavy = [], [], [], []
        self.need, self.load = np.zeros(len(members), np.int64), np.full(len(members), np.inf)
        width = len(passages)
        runs: dict[int, list[int]] = defaultdict(list)
        for j, item in enumerate(members):
            words, answer = items.words[item], items.answers[item]
            own, counts = np.unique(words, return_counts=True)
            order = np.lexsort((own, passages[own]))
            lacks = len(words) - math.ceil(similarity * len(words) - 1e-9)
            total = np.cumsum(counts[order])
            most = int(np.searchsorted(total, lacks + max(2, SPARE * len(words)))) + 1
            load = np.cumsum((weights[own] * counts)[order]) / weights[words].sum()
            if len(words) >= PARAPHRASED and part < 1:
                most = max(most, int(np.searchsorted(load, HEAVY)) + 1)
                self.load[j] = part - (1 - load[:most][-1]) - 1e-9
            self.need[j] = total[:most][-1] - lacks
            heavy.append(np.diff(load[:most], prepend=0))
            terms.append(own[order[:most]])
            times.append(counts[order[:most]])
            owners.append(np.full(len(terms[-1]), j))
            if len(answer) >= 3 and loose < similarity:
                runs[(answer[0] * width + answer[1]) * width + answer[2]].append(j)
        terms = np.concatenate(terms)
        order = np.argsort(terms, kind="stable")
        self.owner, self.times, self.heavy = (np.concatenate(x)[order] for x in (owners, times, heavy))
        self.first = np.searchsorted(terms[order], np.arange(width + 1))
        self.runs, self.keys = dict(runs), np.array(sorted(runs), np.int64)

    def windows(self, places: np.ndarray, terms: np.ndarray, size: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(member, window) of all regions that may hold an item, and of those that may hold a paraphrase; windows are numbered by step."""
        step, before, cells = grid(size)
        width = int(places[-1]) // step + 2 * cells + 2  # no two members' cells are within a region
        many = (self.first[1:] - self.first[:-1])[terms]
        on = np.flatnonzero(many)
        many = many[on]
        at = np.arange(many.sum()) + np.repeat(self.first[terms[on]] - (np.cumsum(many) - many), many)
        key, back = np.unique(self.owner[at] * width + np.repeat(places[on] // step, many), return_inverse=True)
        end = np.searchsorted(key, key + cells)

        def reach(values: np.ndarray, need: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(np.bincount(back, values[at], len(key)))))
            return key[total[end] - total[:-1] >= need[key // width]]

        spots, likely = [reach(self.times, self.need)], reach(self.heavy, self.load)
        if len(self.keys) and len(terms) >= 3:
            n, t = len(self.first) - 1, terms.astype(np.int64)
            run = (t[:-2] * n + t[1:-1]) * n + t[2:]
            for i in np.flatnonzero(np.isin(run, self.keys)).tolist():
                spots.append(np.array([j * width + int(places[i]) // step for j in self.runs[int(run[i])]], np.int64))
        found = [np.unique((x[:, None] + before - np.arange(cells)[None]).ravel()) for x in (np.unique(np.concatenate(spots)), likely)]
        return tuple((x // width, x % width) for x in found)


def _near(places: np.ndarray, terms: np.ndarray, space: np.ndarray, queries: dict, least: float):
    """(size, members, windows, cosines) for each window length: windows, numbered by step, whose cosine to an item is at least least.

    The terms' vectors in space are summed by cells of the smallest step, cells in pairs to those of the next, and a window is a run of cells.
    """
    step = min(grid(size)[0] for size in queries)
    cells = places // step
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sums = np.zeros((int(cells[-1]) + 2, space.shape[1]), np.float32)
    sums[cells[starts]] = sum_rows(space, terms, None, starts)
    for size in sorted(queries):
        matrix = queries[size][1]
        while step < grid(size)[0]:
            half = len(sums) // 2
            joined = np.zeros((half + 2, sums.shape[1]), np.float32)
            np.add(sums[: 2 * half : 2], sums[1 : 2 * half : 2], out=joined[:half])
            joined[half] = sums[2 * half] if len(sums) % 2 else 0
            sums, step = joined, 2 * step
        run = -(-size // step)
        windows = np.zeros((len(sums) + run - 1, sums.shape[1]), np.float32)  # the first one ends in the first cell
        for i in range(run):
            windows[run - 1 - i : len(windows) - i] += sums
        norms = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        on = np.flatnonzero(norms > 0)
        cos = (windows[on] / norms[on, None]) @ matrix
        i, j = np.nonzero(cos >= least)
        yield size, j, on[i] - (run - 1), cos[i, j]


def matches_of(batch: pa.RecordBatch, items: Items, local: np.ndarray, space: np.ndarray, queries: dict, idf: np.ndarray, chance: float, least: float, similarity: float, loose: float, part: float) -> list[tuple]:
    """Rows of LEAKS for the items that a batch of encoded documents holds."""
    ids, n_words = batch.column("doc_id").to_pylist(), batch.column("n_words").to_numpy()
    places, terms = ([np.frombuffer(x, np.int32) for x in batch.column(c).to_pylist()] for c in ("places", "terms"))
    out, a = [], 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(np.cumsum(n_words[a:]), LINE)) + a)
        out += [(ids[a + doc], *row) for doc, *row in _matches(n_words[a:b], places[a:b], terms[a:b], items, local, space, queries, idf, chance, least, similarity, loose, part)]
        a = b
    return out


def _matches(n_words, places, terms, items, local, space, queries, idf, chance, least, similarity, loose, part) -> list[tuple]:
    """(number of the document, item_id, cosine, similarity, start, path).

    All documents lie on one line of words, each from a multiple of every step on, with gaps that no window or region bridges.
    """
    gap, unit = 4 * max(queries), max(grid(size)[0] for size in queries)
    spans = -(-(n_words + gap) // unit) * unit
    base = gap // unit * unit + unit + np.cumsum(spans) - spans
    counts = np.array([len(x) for x in places], np.int64)
    places = np.concatenate(places).astype(np.int64) + np.repeat(base, counts)
    terms = local[np.concatenate(terms)]
    places, terms = places[terms >= 0], terms[terms >= 0].astype(np.int64)
    if not len(places):
        return []
    mark = np.zeros(len(space), bool)
    weights = idf**2
    found: dict[tuple[int, int], tuple[float, float, int, str]] = {}
    for size, near, windows, cosines in _near(places, terms, space, queries, least):
        members, _, rare = queries[size]
        step = grid(size)[0]
        # rows that could stand, and rows that the latent space names and that could be paraphrases
        (exact, at), (likely, there) = rare.windows(places, terms, size)
        wide = int(max(windows.max(initial=0), at.max(initial=0), there.max(initial=0))) + 2 * size
        keys = near * wide + windows + size
        could, may = exact * wide + at + size, likely * wide + there + size
        on = np.isin(keys, may)
        paraphrases = set(keys[on].tolist())
        on |= np.isin(keys, could)
        known = dict(zip(keys[on].tolist(), cosines[on].tolist(), strict=True))
        for key in np.union1d(could, keys[on]).tolist():
            j, window = key // wide, key % wide - size
            item, start = members[j], window * step
            words, s = items.words[item], start - size // 2
            lo, hi = np.searchsorted(places, (s, s + 2 * size))
            region = terms[lo:hi]
            mark[region] = True
            held = words[mark[words]]
            mark[region] = False
            answer = items.answers[item]
            whole = len(held) > 0 and len(held) >= (loose if len(answer) >= 3 else similarity) * len(words)
            alike = key in paraphrases and weights[held].sum() >= part * weights[words].sum() and idf[np.unique(held)].sum() >= chance + len(words) * math.log(2)
            if not whole and not alike:
                continue
            share = lcs(words, region) / len(words)
            said = len(answer) >= 3 and _holds(region.tolist(), answer)
            if share >= similarity or (share >= loose and said):
                path = "sequence"
            elif alike and (share >= part or said):
                path = "latent"
            else:
                continue
            doc = int(np.searchsorted(base, places[lo], "right")) - 1
            pair, place = (doc, items.ids[item]), max(0, s - int(base[doc]))
            cosine, *before = found.get(pair, (0.0, 0.0, 0, ""))
            better = (path, share, -place) > (before[2], before[0], -before[1])  # sequence before latent
            found[pair] = (max(known.get(key, 0.0), cosine), *((share, place, path) if better else before))
    return [(*pair, *v) for pair, v in found.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, loose: float = 0.6, least: float = 0.6, part: float = 0.4) -> DataFrame:
    """(doc_id, item_id, cosine, similarity, start, path) for every document and benchmark item it holds.

    Passages and items become TF-IDF vectors over the items' terms (words, lower case; the square of the smoothed logarithm
    of inverse passage frequency, so no term is left out however common) and are projected on the leading singular
    vectors of all documents' passages. Windows about as long as an item whose cosine to it is at least least are the
    latent search's candidates. Such a window is a paraphrase (path latent) if the words around (twice its length) have part
    of the item's weight, and the longest common subsequence of the item and them covers part of the item or its answer (at
    least three words) stands there in one run. So many of the item's words must also be more than chance: the product of
    the shares of passages that hold each of them, times the passages, the items and the item's sets of words, is at most 1.
    Only the latent search finds these; part of 1 or a least above 1 leaves them out.

    A window holds the item in sequence (path sequence) if the longest common subsequence covers similarity of the item, or
    loose of it and the answer stands there. These are looked for whatever the cosine: all windows with enough of the item's
    words around (see Rare) are checked, so none is lost. cosine is the best one of the windows that stand and that the
    latent search named, 0 if it named none. Windows start at multiples of grid()'s step, so what is found depends on the
    document alone; of several windows one in sequence, then the one that covers most, and the first of these, is reported.

    Items of fewer than PARAPHRASED words have no paraphrases. An item of one or two words is held by each document that has
    them (so a benchmark of single common words has very many rows): such items say nothing and are best left out.

    Null and empty texts hold nothing; items without words are passed over, as is a null item_id's name (it comes back
    null). Repeated rows are found as often as they occur, repeated items under each id. An empty table on either side
    gives no rows. Whole texts are read; extra columns are not. Documents are encoded once for all items, or once for each
    VOCABULARY different words of theirs.
    """
    spark = docs.sparkSession
    parts, terms, group = [], {}, []
    for r in [*benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator(), None]:
        if r is not None and (words := words_of(r.text)):
            own = [terms.setdefault(w, len(terms)) for w in words]
            group.append((r.item_id, own, [terms[w] for w in answer_of(r.text) if w in terms]))
        if group and (r is None or len(terms) >= VOCABULARY):
            parts += _group(docs, terms, group, similarity, loose, least, part)
            terms, group = {}, []
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], LEAKS)


LEAKS = "doc_id long, item_id long, cosine double, similarity double, start long, path string"


def _group(docs: DataFrame, terms: dict[str, int], group: list[tuple], similarity: float, loose: float, least: float, part: float) -> list[DataFrame]:
    encoded = cut(encode(docs, terms), "encoded")
    if (parts := docs.sparkSession.sparkContext.defaultParallelism) > encoded.rdd.getNumPartitions():
        encoded = encoded.repartition(parts)  # a small table, which would be read by too few tasks
    total, passages = frequencies(encoded, len(terms))
    return [_block(encoded, Items(group[i : i + ITEMS]), total, passages, similarity, loose, least, part) for i in range(0, len(group), ITEMS)]


def _block(encoded: DataFrame, items: Items, total: int, passages: np.ndarray, similarity: float, loose: float, least: float, part: float) -> DataFrame:
    local, passages = items.local(len(passages)), passages[items.terms]
    idf = np.log((1 + total) / (0.5 + passages))
    weights, chance = idf**2, math.log(1 + total) + math.log(len(items.ids))
    space = (weights[:, None] * latent(encoded, local, weights)).astype(np.float32)
    queries = {}
    for size, own in items.windows.items():
        m = np.stack([space[items.words[i]].sum(axis=0) for i in own], axis=1)
        queries[size] = (own, m / np.maximum(np.linalg.norm(m, axis=0), 1e-9), Rare(items, own, passages, weights, similarity, loose, part))
    shared = encoded.sparkSession.sparkContext.broadcast((items, local, space, queries, idf, chance))

    def run(batches):
        own = shared.value
        for batch in batches:
            rows = matches_of(batch, *own, least, similarity, loose, part)
            names = [x.split()[0] for x in LEAKS.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return encoded.mapInArrow(run, LEAKS)
