"""Readers of corpora, questions, logs and caches. All go through Spark's readers, so any file system will do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T

METADATA = "title string, author string, source string, link string, copyright string, yearpub string, pub_date string, period string, tokenlen long"
QA = "array<struct<question_id:string,question:string,choices:array<struct<label:string,text:string>>,correct_answer:string,proofs:array<struct<document_id:string,context:string>>>>"
STRUCTURED = "document struct<id:string,title:string,author:string,publication_date:string,references:array<string>>, entities array<struct<name:string,type:string,aliases:array<string>>>, triplets array<struct<subject:string,relationship:string,object:string,chunk_id:string,rank:int>>"
LOG = "run_id string, timestamp string, entry_type string, identifier string, value string"
STAMP = "yyyy-MM-dd HH:mm:ss"


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(doc_id, value): whole files <doc_id><suffix> anywhere below path."""
    own = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    name = F.element_at(F.split("_metadata.file_name", "/"), -1)
    return own.select(F.try_url_decode(F.regexp_replace(F.regexp_replace(name, re.escape(suffix) + "$", ""), r"\+", "%2B")).alias("doc_id"), "value")


def documents(spark: SparkSession, path: str, strip_backslash: bool = False) -> DataFrame:
    """Document folders: <id>_metadata.json, <id>_raw.txt and perhaps <id>_qa.json. Missing texts are null, malformed questions none."""
    meta = _files(spark, path, "_metadata.json").select("doc_id", F.from_json("value", METADATA).alias("m"))
    raw = _files(spark, path, "_raw.txt").withColumnRenamed("value", "raw")
    qa = _files(spark, path, "_qa.json").select("doc_id", F.from_json("value", QA).alias("qa_pairs"))
    met = meta.join(raw, "doc_id", "left").join(qa, "doc_id", "left")
    return met.select(
        "doc_id", "m.title", "m.author", "m.source", F.try_to_date("m.pub_date").alias("publication_date"), F.try_to_number("m.yearpub", F.lit("9999")).cast("int").alias("year"),
        T.refs(F.col("raw")).alias("references"), T.without_refs(F.col("raw"), strip_backslash).alias("text"), F.coalesce("qa_pairs", F.array().cast(QA)).alias("qa_pairs"))


def questions(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Questions of a QA.json and all documents', repeated ones too."""
    own = docs.select(F.explode("qa_pairs").alias("q")).select("q.*")
    if path is None:
        return own
    shared = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", QA)).alias("q")).select("q.*")
    return shared.unionByName(own)


def with_distractors(base: DataFrame, more: DataFrame) -> DataFrame:
    """Base documents, then distractors; part keeps the order."""
    return base.withColumn("part", F.lit(0)).unionByName(more.withColumn("part", F.lit(1)))


def structured(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STRUCTURED).option("multiLine", True).json(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with their order; run files may be many. Time stamps that do not parse are null."""
    own = spark.read.schema(LOG).option("header", True).option("multiLine", True).csv(path)
    return own.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit(STAMP))).withColumn("row_no", F.monotonically_increasing_id())


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, text) of a dump of JSON lines, also compressed; links stay, paragraphs are joined by blank lines."""
    line = "id string, title string, text array<array<string>>"
    own = spark.read.text(path).select(F.from_json("value", line).alias("j")).where("j.title is not null").select("j.*")
    joined = F.array_join(F.transform("text", lambda p: F.array_join(p, "")), "\n\n")
    return own.select("id", "title", T.unescaped(T.tags_but_links_removed(joined)).alias("text"))


def tagged_articles(spark: SparkSession, path: str) -> DataFrame:
    """The same from <doc id=".." title="..">..</doc> elements."""
    parts = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<doc\b.*?</doc>"), F.lit(0))).alias("d"))
    pick = lambda name: F.regexp_extract("d", rf'{name}="(.*?)"', 1)
    return parts.select(pick("id").alias("id"), pick("title").alias("title"), F.regexp_extract("d", r"(?s)<doc\b[^>]*>\s*(.*?)\s*</doc>", 1).alias("text"))


def multi_hop(spark: SparkSession, corpus: str, queries: str) -> tuple[DataFrame, DataFrame]:
    """News corpus and questions: documents (doc_id, title, source, year, text) and questions with proofs by title."""
    docs = spark.read.option("multiLine", True).schema("title string, author string, source string, url string, category string, published_at string, body string").json(corpus)
    docs = docs.select(T.safe_filename(F.col("title")).alias("doc_id"), "title", "author", T.domain(F.col("url")).alias("source"), T.publication_year(F.col("published_at")).alias("year"), F.col("body").alias("text"))
    asked = spark.read.option("multiLine", True).schema("query string, answer string, evidence_list array<struct<title:string,fact:string>>").json(queries)
    asked = asked.withColumn("question_id", F.md5("query"))
    facts = asked.select("question_id", F.posexplode("evidence_list").alias("pos", "e")).select("question_id", "pos", "e.title", "e.fact")
    ids = docs.select(F.col("title").alias("_t"), "doc_id").dropDuplicates(["_t"])
    proofs = facts.join(ids, F.col("title") == F.col("_t"), "left").select("question_id", "pos", F.coalesce("doc_id", T.safe_filename(F.col("title"))).alias("document_id"), F.col("fact").alias("context"))
    return docs, asked.select("question_id", F.col("query").alias("question"), F.col("answer").alias("correct_answer")).join(proofs, "question_id", "left")


def novel_questions(spark: SparkSession, path: str) -> DataFrame:
    """(book, question_id, question, labels, choices, gold) from maps of questions, one file a book."""
    value = "map<string, struct<Question:string, Options:map<string,string>, Gold:string, Evidences:map<string, struct<Evidence:string, Sent:string>>>>"
    own = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.(json|sjon)$", "").alias("book"), F.explode(F.from_json("value", value)).alias("question_id", "q"))
    return own.select("book", "question_id", F.col("q.Question").alias("question"), F.map_keys("q.Options").alias("labels"), F.map_values("q.Options").alias("choices"), F.col("q.Gold").alias("gold"), F.transform(F.map_values("q.Evidences"), lambda e: F.coalesce(e["Evidence"], e["Sent"])).alias("evidence"))


def fact_questions(spark: SparkSession, path: str) -> DataFrame:
    """Multi-hop questions that have supporting facts, each fact as the sentence it points to."""
    raw = "_id string, question string, answer string, supporting_facts array<array<string>>, context array<array<string>>"
    own = spark.read.option("multiLine", True).schema(raw).json(path)
    pages = F.map_from_entries(F.transform("context", lambda c: F.struct(c[0], F.from_json(c[1], "array<string>"))))
    facts = F.transform(F.filter("supporting_facts", lambda f: F.size(f) == 2), lambda f: F.struct(f[0].alias("title"), F.try_element_at(F.try_element_at(pages, f[0]), f[1].cast("int") + 1).alias("sentence")))
    return own.select(F.col("_id").alias("question_id"), "question", "answer", facts.alias("facts")).where(F.size("facts") > 0)


def openie(spark: SparkSession, path: str) -> DataFrame:
    """Stored extractions under recomputed keys."""
    one = "struct<docs:array<struct<idx:string,passage:string,extracted_entities:array<string>,extracted_triples:array<array<string>>>>>"
    own = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", one)["docs"]).alias("d")).select("d.*")
    return own.withColumn("idx", T.content_id("chunk-", F.col("passage")))


def openie_averages(docs: DataFrame) -> DataFrame:
    """Mean letters and words of extracted entities, to four digits."""
    e = docs.select(F.explode("extracted_entities").alias("e"))
    return e.agg(F.round(F.avg(F.length("e")), 4).alias("avg_ent_chars"), F.round(F.avg(F.size(T.words(F.col("e")))), 4).alias("avg_ent_words"))


def missing(keys: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a cache or an earlier, interrupted run has not got yet."""
    return keys.join(done.select(key), key, "left_anti")


def captured_abstracts(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, year, abstract) of article sets in XML, as the literature service sends them; fetching is not done here."""
    own = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<PubmedArticle\b.*?</PubmedArticle>"), F.lit(0))).alias("x"))
    pick = lambda at: F.xpath_string("x", F.lit(at))
    return own.select(pick("//PMID").alias("pmid"), pick("//ArticleTitle").alias("title"), pick("//PubDate/Year").alias("year"), T.joined_abstract(F.xpath("x", F.lit("//AbstractText/text()"))).alias("abstract"))
