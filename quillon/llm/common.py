"""What the operators of this subpackage share: folders that survive executors, hot keys, and word indexes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space inside a line or between words.
BLANKS = " \t\n\x0b\f\r"
#: A key is hot if it holds more than one of so many parts of all rows, so there are at most so many hot keys.
HOT_PARTS = 16384
#: Nor is any key hot that has fewer rows.
HOT_ROWS = 1000
#: A set of so many numbers may be broadcast.
SMALL = 1_000_000
#: Most rows and bytes of an Arrow batch. A worker's lists of words take some fifteen times the bytes of a batch of texts.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 19}
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder inside the one that driver and executors share (spark.checkpoint.dir).

    Where that is unset, a session whose executors are this machine's (as in tests) gets a temporary folder; a cluster
    must name one.
    """
    app = spark.sparkContext.applicationId
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quillon-")
        base = _own[app]
    return f"{base.rstrip('/')}/quillon-{app}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: no lineage, and no loss with an executor.

    forget() deletes one such table once nothing reads it, clear() all of the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quillon_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more; other tables are passed over."""
    for df in tables:
        if path := getattr(df, "_quillon_path", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that cut() wrote in this session. Results are lazy: write them first."""
    _delete(spark, shared_dir(spark))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session in rows and bytes, since whole texts can be long.

    All operators set the same bounds and never raise those that are set, so it does not matter which of them is built
    last before a lazy plan runs.
    """
    for key, most in ARROW.items():
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def hot_limit(total: int) -> int:
    """From so many rows a key counts as hot."""
    return max(HOT_ROWS, total // HOT_PARTS)


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of big with small, which has one row for each key and the key's rows in column count.

    Hot keys, of which there are at most HOT_PARTS, are broadcast and never shuffled; the others meet in a shuffle,
    where none has more than total / HOT_PARTS rows. count is dropped.
    """
    limit = hot_limit(total)
    marked = small.where(F.col(count) >= limit).select(*keys, *[c for c in small.columns if c not in keys and c != count])
    rest = small.where(F.col(count) < limit).drop(count)
    hot = big.join(F.broadcast(marked), keys)
    cold = big.join(F.broadcast(marked.select(*keys)), keys, "left_anti").join(rest, keys)
    return hot.unionByName(cold)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in gone (null keys stay). gone is broadcast if it has at most SMALL keys, so wide rows need no shuffle."""
    gone = cut(gone.select(key).where(F.col(key).isNotNull()).distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= SMALL else gone, key, "left_anti")


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    lower() does just that unless there are capitals beyond ASCII; only then is the slow translate() used.
    """
    beyond = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(beyond, F.translate(text, letters, letters.lower())).otherwise(F.lower(text))


class WordIndex(dict):
    """Numbers for words, in order of appearance; fresh holds those that were added since it was last emptied."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.fresh = most, []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    @property
    def full(self) -> bool:
        return len(self) > self.most


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run of these lengths starts when they are laid end to end."""
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)


def sum_runs(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of values (one row an item) over runs of these lengths, some of which may be empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


LETTERS = re.compile(r"[^\W\d_]+")
WORDS = re.compile(r"\w+")
