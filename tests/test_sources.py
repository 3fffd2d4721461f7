from pyspark.sql import functions as F

from quillon.sources import readers, writers


def test_abstracts(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Set><PubmedArticle><PMID>1</PMID><ArticleTitle>T</ArticleTitle><PubDate><Year>2001</Year></PubDate><AbstractText>A. </AbstractText><AbstractText>B.</AbstractText></PubmedArticle></Set>")
    assert tuple(readers.captured_abstracts(spark, str(tmp_path)).first()) == ("1", "T", "2001", "A. B.")


def test_tagged_articles(spark, tmp_path):
    (tmp_path / "a").write_text('<doc id="1" title="T">\nx\ny\n</doc>\n<doc id="2" title="U">z</doc>')
    assert [tuple(r) for r in readers.tagged_articles(spark, str(tmp_path)).orderBy("id").collect()] == [("1", "T", "x\ny"), ("2", "U", "z")]


def test_fact_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"_id": "1", "question": "q", "answer": "a", "supporting_facts": [["T", 1], ["U", 9]], "context": [["T", ["s0", "s1"]], ["U", ["u0"]]]}, {"_id": "2", "supporting_facts": [], "context": []}]')
    rows = readers.fact_questions(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and [tuple(f) for f in rows[0].facts] == [("T", "s1"), ("U", None)]


def test_novel_questions(spark, tmp_path):
    (tmp_path / "B1.sjon").write_text('{"Q1": {"Question": "q", "Options": {"A": "x", "B": "y"}, "Gold": "A", "Evidences": {"0": {"Sent": "s"}}}}')
    r = readers.novel_questions(spark, str(tmp_path)).first()
    assert (r.book, r.labels, r.gold, r.evidence) == ("B1", ["A", "B"], "A", ["s"])


def test_multi_hop(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"title": "A: b", "url": "https://www.x.org/1", "published_at": "2023-01-02T00:00:00", "body": "t"}]')
    (tmp_path / "q.json").write_text('[{"query": "q", "answer": "a", "evidence_list": [{"title": "A: b", "fact": "f"}, {"title": "No|pe", "fact": "g"}]}]')
    docs, asked = readers.multi_hop(spark, str(tmp_path / "c.json"), str(tmp_path / "q.json"))
    assert tuple(docs.select("doc_id", "source", "year").first()) == ("A_ b", "x.org", "2023")
    assert [r.document_id for r in asked.orderBy("pos").collect()] == ["A_ b", "No_pe"]


def test_solutions(spark):
    found = spark.createDataFrame([(1, r, f"t{r}", 1 / r) for r in range(1, 8)], "query_id int, rank int, text string, score double")
    r = writers.solutions(found, spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, answer string")).where(F.col("query_id") == 1).first()
    assert r.docs == ["t1", "t2", "t3", "t4", "t5"] and r.doc_scores[2] == 0.3333
