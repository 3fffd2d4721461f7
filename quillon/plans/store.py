"""A corpus store of parquet tables: idempotent inserts, merges, cascading deletes, lookups and search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import knowledge as K
from quillon.operators import lexical, segment


def insert_missing(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """have and the rows of new whose key it lacks, one for each key."""
    fresh = new.join(have.select(key), key, "left_anti").dropDuplicates([key])
    return have.unionByName(fresh.select(*have.columns))


def upsert(have: DataFrame, new: DataFrame, key: str, keep_if_null: list[str] | None = None) -> DataFrame:
    """new replaces rows of equal key; columns of keep_if_null stay as they were where new has null. One row of new a key."""
    if keep_if_null:
        old = have.select(key, *[F.col(c).alias(f"_{c}") for c in keep_if_null])
        new = new.join(old, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in keep_if_null}).select(*have.columns)
    return have.join(new.select(key), key, "left_anti").unionByName(new.select(*have.columns))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    whole = F.max_by(F.struct(*rows.columns), order)
    return rows.groupBy(key).agg(whole.alias("r")).select("r.*")


def replace_group(have: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of new's groups give way to new's."""
    return have.join(new.select(group).distinct(), group, "left_anti").unionByName(new.select(*have.columns))


def merge_entities(have: DataFrame, new: DataFrame) -> DataFrame:
    """(name, type, aliases): aliases add up, the newer type counts."""
    n = new.select("name", F.col("type").alias("_t"), F.col("aliases").alias("_a"))
    none = F.array().cast("array<string>")
    return have.join(n, "name", "full").select("name", F.coalesce("_t", "type").alias("type"), F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("_a", none))).alias("aliases"))


def merge_assertions(have: DataFrame, new: DataFrame) -> DataFrame:
    """(id, predicate, rank, chunks): ranks add up, chunks unite, the older predicate stays."""
    n = new.select("id", F.col("predicate").alias("_p"), F.col("rank").alias("_r"), F.col("chunks").alias("_c"))
    none = F.array().cast("array<string>")
    return have.join(n, "id", "full").select("id", F.coalesce("predicate", "_p").alias("predicate"), (F.coalesce("rank", F.lit(0)) + F.coalesce("_r", F.lit(0))).alias("rank"), F.array_sort(F.array_distinct(F.concat(F.coalesce("chunks", none), F.coalesce("_c", none)))).alias("chunks"))


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Documents of ids (doc_id) go with their chunks, and so does every assertion that touches those, even if others do too. Entities stay."""
    gone = tables["chunks"].join(ids, "doc_id", "left_semi").select("chunk_id")
    touched = tables["derived"].join(gone, "chunk_id", "left_semi").select("id").distinct()
    return tables | {
        "documents": tables["documents"].join(ids, "doc_id", "left_anti"), "chunks": tables["chunks"].join(ids, "doc_id", "left_anti"),
        "assertions": tables["assertions"].join(touched, "id", "left_anti"), "derived": tables["derived"].join(touched, "id", "left_anti")}


def delete_sharing(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Documents of ids go; assertions survive if a chunk that stays has them too."""
    stay = tables["chunks"].join(ids, "doc_id", "left_anti")
    derived = tables["derived"].join(stay.select("chunk_id"), "chunk_id", "left_semi")
    return tables | {"documents": tables["documents"].join(ids, "doc_id", "left_anti"), "chunks": stay, "derived": derived, "assertions": tables["assertions"].join(derived.select("id").distinct(), "id", "left_semi")}


class CorpusStore:
    """Documents, chunks, assertions and entities in a folder. Each change writes new table versions and then names them, so readers never see half of one."""

    SCHEMAS = {
        "documents": "doc_id string, title string, author string, publication_date date, text string",
        "chunks": "chunk_id string, doc_id string, chunk_no int, text string",
        "assertions": "id string, predicate string, rank long, chunks array<string>",
        "derived": "id string, chunk_id string",
        "entities": "name string, type string, aliases array<string>",
    }

    def __init__(self, spark: SparkSession, path: str, chunk_words: int = 1200):
        self.spark, self.path, self.chunk_words = spark, path.rstrip("/"), chunk_words

    def _versions(self) -> dict[str, str]:
        fs, at = self._fs("versions")
        if not fs.exists(at):
            return {}
        return {r.name: r.version for r in self.spark.read.schema("name string, version string").json(f"{self.path}/versions").collect()}

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def table(self, name: str) -> DataFrame:
        version = self._versions().get(name)
        if version is None:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.path}/{name}/{version}")

    def _save(self, tables: dict[str, DataFrame]) -> None:
        old = self._versions()
        new = {}
        for name, df in tables.items():
            new[name] = uuid.uuid4().hex
            df.write.parquet(f"{self.path}/{name}/{new[name]}")
        rows = list((old | new).items())
        self.spark.createDataFrame(rows, "name string, version string").coalesce(1).write.mode("overwrite").json(f"{self.path}/versions")
        for name in new:
            if name in old:
                fs, at = self._fs(f"{name}/{old[name]}")
                fs.delete(at, True)

    def initialize(self) -> None:
        self._save({n: self.spark.createDataFrame([], s) for n, s in self.SCHEMAS.items()})

    def add(self, documents: DataFrame, triples: DataFrame | None = None) -> None:
        """Upsert documents, replace their chunks, and merge the assertions of triples (pos, s, r, o, chunk, rank)."""
        columns = self.table("documents").columns
        docs = documents.select(*[F.col(c) if c in documents.columns else F.lit(None).cast(dict(self.table("documents").dtypes)[c]).alias(c) for c in columns])
        pieces = segment.word_chunks(docs, self.chunk_words).select("chunk_id", "doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), "text")
        ids = docs.select("doc_id").distinct()
        chunks = self.table("chunks").join(ids, "doc_id", "left_anti").unionByName(pieces)
        out = {"documents": upsert(self.table("documents"), docs, "doc_id", ["publication_date"]), "chunks": chunks.select("chunk_id", "doc_id", "chunk_no", "text")}
        if triples is not None:
            made = K.assertions(triples).select("id", "predicate", F.col("rank").cast("long").alias("rank"), "chunks")
            out["assertions"] = merge_assertions(self.table("assertions"), made)
            out["derived"] = self.table("derived").unionByName(made.select("id", F.explode("chunks").alias("chunk_id"))).distinct()
            names = triples.select(F.explode(F.array("s", "o")).alias("name")).distinct().select("name", F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("aliases"))
            out["entities"] = merge_entities(self.table("entities"), names)
        self._save(out)

    def remove(self, ids: list[str], keep_shared: bool = False) -> None:
        tables = {n: self.table(n) for n in self.SCHEMAS}
        gone = self.spark.createDataFrame([(i,) for i in ids], "doc_id string")
        after = (delete_sharing if keep_shared else delete_cascade)(tables, gone)
        self._save({n: after[n] for n in ("documents", "chunks", "assertions", "derived")})

    def get_all(self) -> DataFrame:
        """(doc_id, title, text), the text put together from chunks."""
        parts = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
        texts = self.table("chunks").groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
        return self.table("documents").select("doc_id", "title").join(texts, "doc_id", "left").fillna({"text": ""})

    def get_by_id(self, doc_id: str):
        return self.get_all().where(F.col("doc_id") == doc_id).first()

    def count(self) -> int:
        return self.table("documents").count()

    def is_populated(self) -> bool:
        return not self.table("documents").isEmpty()

    def query(self, question: str, k: int = 5) -> DataFrame:
        chunks = self.table("chunks").select(F.col("chunk_id").alias("id"), "doc_id", "text")
        asked = self.spark.createDataFrame([(0, question)], "query_id int, text string")
        return lexical.top_k(lexical.index(chunks), asked, k).join(chunks, "id").orderBy("rank")

    def clear(self) -> None:
        self.initialize()


def first_seen(rows: DataFrame, key: str, order: str, known: DataFrame, n: int) -> DataFrame:
    """The first n keys that are not known, each once."""
    fresh = rows.join(known.select(key), key, "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return fresh.orderBy(order).limit(n)
