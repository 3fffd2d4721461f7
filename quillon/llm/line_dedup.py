"""Dropping lines that many documents repeat: range-partitioned hashes, sorted by document and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, fold_ascii, hot_limit

#: Hashes fall into so many buckets when hot ones are looked for, whatever the input's size.
BUCKETS = 1 << 16


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, drops, n_dropped) for every document that loses lines.

    drops is a compressed bitmap: from the number of a 64-line word to the bits of its dropped lines; words whose lines
    all stay are left out. A line's key is the line without blanks at its ends and with A-Z in lower case. Keys of
    min_chars code points or more that min_docs documents or more hold stay in the largest doc_id only.

    Hashes of lines are range-partitioned with a secondary sort by descending document and position, and the first
    document of each run keeps its lines. Hot keys never enter that sort: buckets of hashes are counted first, keys in
    heavy buckets are aggregated on the map side, and the at most 16384 keys that are hot meet their lines by broadcast.
    Rows of one doc_id are one document; a null doc_id is a document smaller than all others.
    """
    key = fold_ascii(F.btrim("line", F.lit(BLANKS)))
    lines = (
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines()).alias("pos", "line"))
        .where(F.length(F.btrim("line", F.lit(BLANKS))) >= min_chars)
        .withColumn("line", key)
        .select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )
    lines = cut(lines, "line-hashes")
    bucket = F.shiftrightunsigned("h1", 48)
    sizes = lines.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most BUCKETS rows of two numbers
    total = sum(r.n for r in sizes)
    limit = hot_limit(total)
    heavy = [r.bucket for r in sizes if r.n >= limit]
    drop = ["doc_id", "text_hash", "pos"]
    rest, parts = lines, []
    if heavy:
        within = lines.join(F.broadcast(docs.sparkSession.createDataFrame([(b,) for b in heavy], "bucket long")), F.col("bucket") == bucket, "left_semi")
        hot = (
            within.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"), F.max("doc_id").alias("keeper"))
            .where(F.col("n") >= limit).select("h1", "h2", "held", "keeper")
        )
        hot = cut(hot, "hot-lines")
        parts = [lines.join(F.broadcast(hot), ["h1", "h2"]).where((F.col("held") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*drop)]
        rest = lines.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    run = Window.partitionBy("h1", "h2")
    ranked = (
        rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc_id"), "pos")
        .withColumn("nth", F.dense_rank().over(run.orderBy(F.desc_nulls_last("doc_id"))))
        .withColumn("held", F.max("nth").over(run))
    )
    parts.append(ranked.where((F.col("held") >= min_docs) & (F.col("nth") > 1)).select(*drop))
    drops = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    word = F.shiftright("pos", 6).alias("word")
    bit = F.expr("shiftleft(1L, pos & 63)")
    return (
        drops.groupBy("doc_id", "text_hash", word).agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text as it is after repeated lines went, and n_lines, n_dropped and drops.

    Null and empty texts are one empty line and come back as ''. Other columns pass through (those named n_lines,
    n_dropped or drops are replaced). Repeated rows stay repeated; an empty table gives an empty one.
    """
    maps = keep_bitmaps(docs, min_chars, min_docs)
    own = docs.drop("n_lines", "n_dropped", "drops").withColumn("__quillon_hash", F.xxhash64("text"))
    maps = maps.select(F.col("doc_id").alias("__quillon_id"), F.col("text_hash").alias("__quillon_text_hash"), "drops", "n_dropped")
    met = own.join(maps, own["doc_id"].eqNullSafe(maps["__quillon_id"]) & (own["__quillon_hash"] == maps["__quillon_text_hash"]), "left").drop("__quillon_id", "__quillon_text_hash", "__quillon_hash")
    stays = F.filter(_lines(), lambda line, i: F.coalesce(F.try_element_at("drops", F.shiftright(i, 6)), F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)))) == 0)
    return met.withColumns({
        "n_lines": F.size(_lines()).cast("long"),
        "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long"),
        "text": F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(stays, "\n")),
    })
