"""Proportional stratified interleaving: every shard holds the sources in the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows are ranked inside buckets; about so many rows fall into one.
BUCKET_ROWS = 200_000


def _ranked(rows: DataFrame, groups: list[str], bucket: str, order: list[str], rank: str) -> DataFrame:
    """Numbers from 1 in each group, by bucket and then by order. Only counts of buckets meet in one task, never a whole group."""
    counts = rows.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("__q_n"))
    before = counts.withColumn("__q_before", F.sum("__q_n").over(Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.withColumn("__q_before", F.coalesce("__q_before", F.lit(0))).withColumn("__q_all", F.sum("__q_n").over(Window.partitionBy(*groups))).drop("__q_n")
    within = rows.withColumn("__q_row", F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)))
    return within.join(before, [*groups, bucket]).withColumn(rank, F.col("__q_before") + F.col("__q_row")).drop("__q_before", "__q_row")


def assign_shards(docs: DataFrame, shards: int = 40, seed: int = 5, strata: str = "source", texts: bool = True) -> DataFrame:
    """docs with size, text_crc32, shard and slot; counts of shards differ by one at most. Without texts, text is left out.

    Rows are shuffled by a seeded hash and ranked within their source; (rank - start) / rows of the source is the
    fractional rank by which all sources are interleaved, start being a number between 0 and 1 that the source's name and
    the seed give, so that sources of few rows do not crowd at one place. The interleaved order is cut into equal shards.
    slot counts from 0 in each shard. Both rankings go through buckets of hash or fractional rank, so a source with a
    third of all rows, or very many sources of a row each, are spread over many tasks. Texts are read once: rows are
    written to the shared folder, without the texts if they are not asked for, and all else is done on those.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 is 0 for null and empty texts. A null source is a
    source of its own, a null doc_id is hashed as an empty one; rows that are equal in everything are interchangeable.
    An empty table gives an empty one. Columns named size, text_crc32, shard or slot are replaced, others pass through.
    """
    bytes_ = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    named = F.concat(F.lit("s"), F.coalesce(F.col(strata).cast("string"), F.lit(""))) if strata in docs.columns else F.lit("s")
    rows = docs.drop("size", "text_crc32", "shard", "slot").withColumns({"size": (F.octet_length(bytes_) + 16).cast("long"), "text_crc32": F.crc32(bytes_)})
    rows = rows.withColumns({
        "__q_source": F.when(F.col(strata).isNull(), F.lit("n")).otherwise(named) if strata in docs.columns else named,
        "__q_key": F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))),
    })
    rows = cut(rows if texts else rows.drop("text"), "rows")
    total = rows.count()
    digits = 2
    while total / 16**digits > BUCKET_ROWS:
        digits += 1
    parts = 16**digits
    rows = rows.withColumn("__q_bucket", F.substring("__q_key", 1, digits))
    tie = ["__q_key", F.asc_nulls_first("doc_id"), "size"]
    start = (F.pmod(F.xxhash64(F.lit(seed), "__q_source"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    rows = _ranked(rows, ["__q_source"], "__q_bucket", tie, "__q_rank").withColumn("__q_share", (F.col("__q_rank") - start) / F.col("__q_all"))
    rows = rows.drop("__q_all", "__q_bucket", "__q_rank").withColumn("__q_bucket", F.floor(F.col("__q_share") * parts))
    rows = _ranked(rows.withColumn("__q_one", F.lit(1)), ["__q_one"], "__q_bucket", ["__q_share", *tie, "__q_source"], "__q_rank")
    at = F.col("__q_rank") - 1
    shard = F.expr(f"cast((__q_rank - 1) * {shards} div __q_all as int)")
    return (
        rows.withColumn("shard", shard)
        .withColumn("slot", (at - F.expr(f"(cast(shard as bigint) * __q_all + {shards - 1}) div {shards}")).cast("long"))
        .drop("__q_source", "__q_key", "__q_bucket", "__q_share", "__q_one", "__q_rank", "__q_all")
    )
