"""Metrics of run logs: long tables of run_id, timestamp, entry_type, identifier, value (all text but the timestamp).

Every function takes all runs at once and returns a row for each run (or run and step), so a thousand logs are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Assumed prices in dollars for a million tokens in and out.
PRICE_IN, PRICE_OUT = 0.25, 0.50


def number(c: Column | str = "value") -> Column:
    return F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")


def of(kind: str) -> Column:
    return F.col("entry_type") == kind


def values(log: DataFrame, kind: str, ids: DataFrame | None = None) -> DataFrame:
    """Numbers of one entry type, of some identifiers if ids (run_id, identifier) is given."""
    own = log.where(of(kind))
    own = own.join(ids.select("run_id", "identifier").distinct(), ["run_id", "identifier"], "left_semi") if ids is not None else own
    return own.select("run_id", "identifier", number().alias("number")).dropna(subset=["number"])


def ranks(log: DataFrame, kind: str = "proof", lenient: bool = False) -> DataFrame:
    """Proof ranks; -1 stands for not found. lenient drops rows that are no numbers instead of counting them as not found."""
    rank = F.floor(number()).cast("int")
    own = log.where(of(kind)).select("run_id", "identifier", rank.alias("rank"))
    return own.where("rank is not null") if lenient else own.fillna({"rank": -1})


def recall_at_k(log: DataFrame, ks: list[int], kind: str = "proof", empty: float | None = 0.0) -> DataFrame:
    """run_id and recall_<k>: the mean over questions of the share of proofs found within k, in percent; empty for runs without proofs."""
    found = [F.avg(((F.col("rank") >= 0) & (F.col("rank") < k)).cast("double")).alias(f"recall_{k}") for k in ks]
    by_question = ranks(log, kind, lenient=empty is None).groupBy("run_id", "identifier").agg(*found)
    means = by_question.groupBy("run_id").agg(*[(F.avg(f"recall_{k}") * 100).alias(f"recall_{k}") for k in ks])
    out = log.select("run_id").distinct().join(means, "run_id", "left")
    return out if empty is None else out.fillna({f"recall_{k}": empty for k in ks})


def accuracy(log: DataFrame, kind: str = "correctness") -> DataFrame:
    return log.where(of(kind)).groupBy("run_id").agg((F.avg((F.col("value") == "correct").cast("double")) * 100).alias("accuracy"))


def faithfulness(log: DataFrame, k: int, proofs: str = "proof", kind: str = "correctness") -> DataFrame:
    """run_id, faithfulness and unsupported: percent correct among questions with and without a proof within k. A question's last verdict counts."""
    grounded = ranks(log, proofs).groupBy("run_id", "identifier").agg(F.max(((F.col("rank") >= 0) & (F.col("rank") < k)).cast("int")).alias("grounded"))
    verdict = log.where(of(kind)).groupBy("run_id", "identifier").agg(F.max_by("value", F.struct("timestamp", "row_no")).alias("verdict"))
    met = grounded.join(verdict, ["run_id", "identifier"], "left").withColumn("right", F.coalesce((F.col("verdict") == "correct").cast("double"), F.lit(0.0)))
    return met.groupBy("run_id").agg(
        F.coalesce(F.avg(F.when(F.col("grounded") == 1, F.col("right"))) * 100, F.lit(0.0)).alias("faithfulness"),
        F.coalesce(F.avg(F.when(F.col("grounded") == 0, F.col("right"))) * 100, F.lit(0.0)).alias("unsupported"))


def value_stats(log: DataFrame, kind: str) -> DataFrame:
    n = number()
    return log.where(of(kind)).groupBy("run_id").agg(F.avg(n).alias("mean"), F.median(n).alias("median"))


def counts(log: DataFrame, documents: str, answers: str, chunks: str) -> DataFrame:
    return log.groupBy("run_id").agg(
        F.countDistinct(F.when(of(documents), F.col("identifier"))).alias("num_documents"),
        F.countDistinct(F.when(of(answers), F.col("identifier"))).alias("num_questions"),
        F.coalesce(F.floor(F.sum(F.when(of(chunks), number()))), F.lit(0)).alias("num_chunks"))


def indexing_times(log: DataFrame, kind: str, total: str = "total") -> DataFrame:
    """Mean over documents, and the time logged under identifier total, else the sum."""
    single = of(kind) & (F.col("identifier") != total)
    return log.groupBy("run_id").agg(
        F.avg(F.when(single, number())).alias("indexing_avg"),
        F.coalesce(F.max(F.when(of(kind) & (F.col("identifier") == total), number())), F.sum(F.when(single, number())), F.lit(0.0)).alias("indexing_total"))


def per_question(log: DataFrame, kind: str) -> DataFrame:
    """Mean over questions of each question's sum."""
    return log.where(of(kind)).groupBy("run_id", "identifier").agg(F.sum(number()).alias("t")).groupBy("run_id").agg(F.avg("t").alias("time_avg"))


def calls_per_question(log: DataFrame, calls: str, answers: str) -> DataFrame:
    """Mean calls over answered questions that have any, and the mean of their values."""
    own = values(log, calls, log.where(of(answers)))
    each = own.groupBy("run_id", "identifier").agg(F.count(F.lit(1)).alias("n"), F.sum("number").alias("s"))
    return each.groupBy("run_id").agg(F.avg("n").alias("calls"), (F.sum("s") / F.sum("n")).alias("call_avg"))


def execution_time(log: DataFrame) -> DataFrame:
    s = F.unix_timestamp(F.max("timestamp").cast("timestamp")) - F.unix_timestamp(F.min("timestamp").cast("timestamp"))
    own = log.groupBy("run_id").agg(s.alias("s"))
    text = F.format_string("%d h %d m %d s", F.floor(F.col("s") / 3600), F.floor(F.col("s") % 3600 / 60), F.col("s") % 60)
    return own.select("run_id", F.col("s").alias("seconds"), text.alias("execution_time"))


def token_totals(log: DataFrame, inputs: list[str], outputs: list[str], answers: str | None = None) -> DataFrame:
    own = log if answers is None else log.join(log.where(of(answers)).select("run_id", "identifier").distinct(), ["run_id", "identifier"], "left_semi")
    return own.groupBy("run_id").agg(*[F.coalesce(F.sum(F.when(F.col("entry_type").isin(kinds), number())), F.lit(0.0)).alias(name) for name, kinds in (("tokens_in", inputs), ("tokens_out", outputs))])


def cost(actual: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """The logged cost if there is one, else the assumed prices."""
    return F.when(actual > 0, actual).otherwise(tokens_in / 1e6 * PRICE_IN + tokens_out / 1e6 * PRICE_OUT)


def summary(log: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row a run, one pass: each name is (entry type, "sum", "avg" or "count")."""
    pick = {"sum": F.sum, "avg": F.avg, "count": F.count}
    return log.groupBy("run_id").agg(*[F.coalesce(pick[how](F.when(of(kind), number())), F.lit(0)).cast("double").alias(name) for name, (kind, how) in names.items()])


def matrix(table: DataFrame, rows: str, columns: str, value: str, row_values: list, column_values: list) -> DataFrame:
    """Every row and column, missing cells 0."""
    wide = table.where(F.col(rows).isin(row_values)).groupBy(rows).pivot(columns, column_values).agg(F.first(value))
    every = table.sparkSession.createDataFrame([(r,) for r in row_values], f"{rows} {dict(table.dtypes)[rows]}")
    return every.join(wide, rows, "left").fillna(0)


def time_statistics(log: DataFrame, kind: str) -> DataFrame:
    n = number()
    return log.where(of(kind)).groupBy("run_id").agg(
        F.count(n).alias("documents"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.median(n).alias("median"),
        F.stddev_pop(n).alias("deviation"), F.sum(n).alias("total_ms"), (F.sum(n) / 1000).alias("total_s"), (F.sum(n) / 60000).alias("total_min"))


def cumulative(log: DataFrame, kind: str) -> DataFrame:
    """A run's values in order of time with their running sum. Runs are the unit of distribution; a run's log is one file."""
    w = Window.partitionBy("run_id").orderBy("timestamp", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    return log.where(of(kind)).select("run_id", "row_no", "timestamp", number().alias("n")).select("run_id", "row_no", F.row_number().over(Window.partitionBy("run_id").orderBy("timestamp", "row_no")).alias("step"), F.sum("n").over(w).alias("running"))


def segments(log: DataFrame, marker: Column) -> DataFrame:
    """log with step: rows up to and with each marker row form a step (from 0)."""
    w = Window.partitionBy("run_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("step", F.coalesce(F.sum(marker.cast("int")).over(w), F.lit(0)))


def blocks(log: DataFrame, start: Column) -> DataFrame:
    """log with block: a new block at each row that starts one."""
    return log.withColumn("block", F.sum(start.cast("int")).over(Window.partitionBy("run_id").orderBy("row_no")))


def step_totals(log: DataFrame, marker: Column, kind: str) -> DataFrame:
    """run_id, step, total, calls, mean of the steps' values, and adjusted: the marker's value less total plus the overall mean."""
    cut = segments(log, marker)
    own = cut.groupBy("run_id", "step").agg(
        F.coalesce(F.sum(F.when(of(kind), number())), F.lit(0.0)).alias("total"), F.count(F.when(of(kind), number())).alias("calls"),
        F.avg(F.when(of(kind), number())).alias("mean"), F.max(F.when(marker, number())).alias("actual"))
    overall = F.avg("total").over(Window.partitionBy("run_id"))
    return own.withColumn("adjusted", F.col("actual") - F.col("total") + overall)


def timing_averages(records: DataFrame, timings: str, by: list[str] | None = None) -> DataFrame:
    """Mean by key over records of maps, and by other columns if given."""
    own = records.select(*(by or []), F.explode(timings).alias("key", "t"))
    return own.groupBy(*(by or []), "key").agg(F.avg("t").alias("average"))


def contributions(rows: DataFrame, features: list[str], weights: dict[str, float]) -> DataFrame:
    """feature and total: the sum of value times weight."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * weights[f]).alias("v")) for f in features])).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.sum("v").alias("total"))


def signal_shares(rows: DataFrame, features: list[str], weights: dict[str, float]) -> DataFrame:
    """feature and share: the mean part of the weighted total, over rows whose total is positive."""
    weighted = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * weights[f] for f in features}
    total = sum(weighted.values(), F.lit(0.0))
    long = rows.withColumn("_total", total).where("_total > 0").select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (v / F.col("_total")).alias("v")) for f, v in weighted.items()])).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.avg("v").alias("share"))


def display_order(name: Column, order: list[str]) -> Column:
    """Position in a preset order; unknown names last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), name)
    return F.when(at == 0, len(order) + 1).otherwise(at)
