"""Pattern packing: few-document length patterns, fitted to the histogram by non-negative least squares, then best fit."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, bound_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long"
#: Rust's and Python's ideas of white space differ in these.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Letters whose lower case and composed form do not depend on their neighbours, and plain ASCII.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+")


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return "".join(chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256))


class WordIds(dict):
    """Token ids (little-endian bytes) by white-space-separated word; the tokenizer never joins words across white space.

    A new word of plain letters is cut by the tokenizer's own pattern, and only parts not seen before go to its model;
    any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 700_000):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.parts = Tokenizer.from_file(path), most, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(self.tokenizer.to_str())
        steps, clean = rules["pre_tokenizer"].get("pretokenizers", []), rules["normalizer"].get("normalizers", [])
        known = [x["type"] for x in steps] == ["Split", "ByteLevel"] and [x["type"] for x in clean] == ["NFC", "Replace", "Lowercase"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        self.cut = regex.compile(steps[0]["pattern"]["Regex"]).findall if known else None
        self.letters, self.model = _byte_letters(), self.tokenizer.model

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            mapped = part.encode().decode("latin-1").translate(self.letters)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
            if len(self.parts) >= self.most:
                self.parts.clear()
            if len(part) < 100:
                self.parts[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        ids = b"".join([self._part(p) for p in self.cut(word.lower())]) if self.cut and _PLAIN.fullmatch(word) else self._ids(word)
        if len(word) < 100:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        """The ids of a whole text. Texts with a special token's string go to the tokenizer whole: it cuts there."""
        if any(s in text for s in self.special):
            return self._ids(text)
        words = [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The token pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian u32).

    Each document's ids end with end_id; only documents of more than size ids are cut. Null and empty texts have end_id
    alone. Repeated rows are packed as often as they occur. _part and _nth number the pieces of equal length in each
    partition.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        words, part, seen = WordIds(tokenizer), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in schema.split(", ")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = words.of(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    n = len(own) // 4
                    for k, v in zip(out, (doc, i, at // 4, n, zlib.crc32(own), part, seen[n], own), strict=False):
                        out[k].append(v)
                    seen[n] += 1
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = PIECES + (", ids binary" if with_ids else "")
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |ax - b| over x >= 0, by active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    ata, atb = a.T @ a, a.T @ b
    for _ in range(rounds):
        gain = np.where(active, -np.inf, atb - ata @ x)
        if not len(gain) or gain.max() <= 1e-9 * max(1.0, np.abs(atb).max()):
            break
        active[gain.argmax()] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(ata[np.ix_(on, on)], atb[on], rcond=None)[0]
            if s.min() > 1e-12:
                x[:] = 0
                x[on] = s
                break
            low = s <= 1e-12
            step = np.min(x[on][low] / np.maximum(x[on][low] - s[low], 1e-300))
            x[on] += np.clip(step, 0, 1) * (s - x[on])
            gone = on[low & (x[on] <= 1e-9)]
            gone = gone if len(gone) else on[[s.argmin()]]
            active[gone], x[gone] = False, 0
    return x


class Plan:
    """How many sequences hold which lengths: groups of equal sequences, (lengths, repeats)."""

    def __init__(self, histogram: dict[int, int], size: int, depth: int = 3, classes: int = 128):
        self.left = Counter({k: v for k, v in histogram.items() if v > 0})
        self.size, self.groups = size, []
        self._patterns(depth, classes)
        self._best_fit()

    def _patterns(self, depth: int, classes: int) -> None:
        """Fit repeats of patterns of 2 to depth length classes that fill a sequence; small pieces are left for the gaps."""
        step = -(-self.size // classes)
        classes = -(-self.size // step)
        small = max(1, classes // 16)
        counts = np.zeros(classes + 1)
        by_class: dict[int, list[int]] = defaultdict(list)
        for n, k in sorted(self.left.items()):
            c = -(-n // step)
            counts[c] += k
            by_class[c].append(n)
        have = [c for c in range(small + 1, classes + 1) if counts[c]]
        kinds: list[tuple[int, ...]] = []

        def grow(parts: tuple[int, ...], rest: int) -> None:
            if len(parts) >= 2 and rest in (0, 1):
                kinds.append(parts)
            if len(parts) < depth:
                for c in have:
                    if c > min(parts[-1] if parts else classes, rest):
                        break
                    grow((*parts, c), rest - c)

        grow((), classes)
        if not kinds:
            return
        a = np.zeros((classes + 1, len(kinds)))
        for j, kind in enumerate(kinds):
            for c in kind:
                a[c, j] += 1
        target = np.where(np.arange(classes + 1) > small, counts, 0)
        repeats = np.floor(nnls(a, target) + 0.5).astype(int)
        for j in np.argsort(-repeats, kind="stable"):
            for _ in range(int(repeats[j]) and 10**9):
                made = self._exact(kinds[j], by_class, int(repeats[j]), step)
                repeats[j] -= made
                if not made or repeats[j] <= 0:
                    break

    def _exact(self, kind: tuple[int, ...], by_class: dict[int, list[int]], most: int, step: int) -> int:
        """One group of a pattern: the largest lengths of its classes, the last one chosen to fit best."""
        lengths: list[int] = []
        for i, c in enumerate(kind):
            room = self.size - sum(lengths)
            fits = [n for n in by_class[c] if n <= room and self.left[n] > lengths.count(n)]
            if not fits:
                return 0
            lengths.append(fits[-1])
        often = Counter(lengths)
        made = min(most, *(self.left[n] // k for n, k in often.items()))
        for n, k in often.items():
            self.left[n] -= k * made
            if not self.left[n]:
                by_class[-(-n // step)].remove(n)
        self.groups.append((lengths, made))
        return made

    def _best_fit(self) -> None:
        """What is left, longest first, goes where it leaves the least room; equal sequences are treated as one."""
        open_: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
        for lengths, made in self.groups:
            open_[self.size - sum(lengths)].append((lengths, made))
        rooms = sorted(open_)
        full = []

        def put(room: int, group: tuple[list[int], int]) -> None:
            if not room:
                full.append(group)
                return
            if room not in open_ or not open_[room]:
                if room not in open_ or room not in rooms:
                    insort(rooms, room)
            open_[room].append(group)

        for n in sorted((k for k, v in self.left.items() if v), reverse=True):
            count = self.left[n]
            while count:
                at = bisect_left(rooms, n)
                if at == len(rooms):
                    fit = self.size // n
                    if count >= fit:
                        put(self.size - fit * n, ([n] * fit, count // fit))
                    if count % fit:
                        put(self.size - count % fit * n, ([n] * (count % fit), 1))
                    break
                room = rooms[at]
                lengths, made = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
                    del open_[room]
                fit = min(room // n, max(1, count // made))
                used = min(made, count // fit)
                put(room - fit * n, ([*lengths, *[n] * fit], used))
                if made > used:
                    put(room, (lengths, made - used))
                count -= fit * used
        self.groups = [*full, *(g for gs in open_.values() for g in gs)]
        self.left.clear()

    def table(self) -> dict[int, tuple[np.ndarray, ...]]:
        """By length: where each run of equal places starts among its pieces, then first sequence, and offset of the run."""
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        first = 0
        for lengths, made in self.groups:
            at = 0
            for n in lengths:
                runs[n].append((made, first, at))
                at += n
            first += made
        out = {}
        for n, rows in runs.items():
            x = np.array(rows, np.int64)
            out[n] = (np.concatenate(([0], np.cumsum(x[:, 0])[:-1])), x[:, 1], x[:, 2])
        return out

    @property
    def sequences(self) -> int:
        return sum(made for _, made in self.groups)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset, in as few sequences of at most size ids as the plan finds.

    The driver sees the histogram of lengths only (size numbers) and returns a plan over lengths; each piece finds its
    place from its rank among the pieces of its length, which is the sum of what earlier partitions hold and its rank in
    its own. No piece is shuffled with its text. Sequences are gapless from offset 0. Cases as in pieces(); an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer, size, end_id, with_ids), "pieces")
    counts = cutted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    table = spark.sparkContext.broadcast(Plan(histogram, size).table())
    before = counts.select("length", "_part", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = cutted.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_before", "_nth", "_part")

    def run(batches):
        plan = table.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                own = n == one
                starts, first, at = plan[one]
                k = np.searchsorted(starts, rank[own], "right") - 1
                sequence[own], offset[own] = first[k] + rank[own] - starts[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = PIECES.split(", ")[:5] + ["ids binary"] * with_ids
    return ranked.select(*kept, "_rank").mapInArrow(run, ", ".join([*types, "sequence_id long", "offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pack(..., with_ids=True)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
