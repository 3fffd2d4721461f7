"""Learning the weights of signals from pairs that should be ranked one above the other."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import forget, written


def scaled(rows: DataFrame, features: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Features with mean 0 and deviation 1, and the deviations."""
    stats = rows.agg(*[f(c).alias(f"{c}_{n}") for c in features for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    dev = {c: stats[f"{c}_s"] or 1.0 for c in features}
    return rows.withColumns({c: (F.col(c) - stats[f"{c}_m"]) / dev[c] for c in features}), dev


def pairwise_weights(rows: DataFrame, group: str, label: str, features: list[str], rounds: int = 60, rate: float = 0.5, margin: float = 0.1) -> dict[str, float]:
    """Non-negative weights under which positives of a group outscore its negatives by margin.

    Projected subgradient steps on the mean hinge loss over all pairs, none of which is made: a row counts, in the order
    of its group's scores, the rows of the other label that it is not margin apart from, so a step is a sort of the rows
    and one aggregate. Weights are given for unscaled features, the largest being 10.
    """
    own, dev = scaled(rows, features)
    own = written(own.where(F.col(label).isin(0, 1) & F.col(group).isNotNull()).select(F.col(group).alias("g"), (F.col(label) == 1).alias("up"), *features), "pairs")
    sizes = own.groupBy("g").agg(F.count_if("up").alias("ups"), F.count_if(~F.col("up")).alias("downs"))
    pairs = sizes.agg(F.sum(F.col("ups").cast("double") * F.col("downs"))).first()[0]
    w = np.full(len(features), 0.5)
    if not pairs:
        return {}
    sound = own.dropna(subset=features)
    for i in range(rounds):
        score = sum((F.col(c) * float(x) for c, x in zip(features, w, strict=True)), F.lit(0.0))
        keyed = sound.withColumn("key", F.when(F.col("up"), score - margin).otherwise(score))
        # at equal keys negatives come first: a positive is short of negatives over its key, a negative of positives under it
        before = Window.partitionBy("g").orderBy("key", "up").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        other = F.when(F.col("up"), F.count_if(~F.col("up")).over(Window.partitionBy("g")) - F.count_if(~F.col("up")).over(before)).otherwise(-F.count_if("up").over(before))
        step = keyed.withColumn("many", other.cast("double")).agg(*[F.sum(F.col(c) * F.col("many")).alias(c) for c in features]).first()
        w = np.maximum(w + rate / np.sqrt(i + 1) * np.array([(step[c] or 0.0) / pairs for c in features]), 0.0)
    forget(own)
    raw = w / np.array([dev[c] for c in features])
    return dict(zip(features, (raw / raw.max() * 10 if raw.max() > 0 else raw).tolist(), strict=True))


def greedy_selection(groups: list[tuple[int, list[str]]], budget: int) -> list[int]:
    """Questions in order whose articles still fit a budget of distinct articles."""
    taken: set[str] = set()
    out = []
    for key, slugs in groups:
        new = set(slugs) - taken
        if len(taken) + len(new) <= budget:
            taken |= new
            out.append(key)
    return out


def greedy_taken(groups: Iterable[tuple[int, list[str]]], budget: int) -> dict[str, int]:
    """The articles that greedy_selection takes, and the question each is taken for; groups are read until the budget is spent."""
    taken: dict[str, int] = {}
    for key, slugs in groups:
        new = set(slugs) - taken.keys()
        if len(taken) + len(new) <= budget:
            taken |= dict.fromkeys(new, key)
            if len(taken) == budget:
                break
    return taken
