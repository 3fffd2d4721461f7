import pytest
from pyspark.sql import functions as F

from quillon.operators import runlog
from quillon.plans import engines

TEXTS = ["Marie Curie worked in Paris on Radium. Paris honoured Marie Curie.", "Niels Bohr lived in Copenhagen. Niels Bohr knew Marie Curie.", "Rivers run to the sea and mountains stand in the cold."]


@pytest.fixture()
def corpus(spark):
    docs = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(TEXTS)], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(1, "Where did Niels Bohr live? Copenhagen", "F"), (2, "mountains stand in the cold", "G")], "query_id long, question string, correct_answer string")
    return docs, asked


@pytest.mark.parametrize("kind", [engines.VectorEngine, engines.LexicalEngine, engines.HybridEngine, engines.FactGraphEngine, engines.TreeEngine])
def test_finds_the_right_document(spark, corpus, kind, tmp_path):
    docs, asked = corpus
    e = kind(spark, str(tmp_path), chunk_words=20)
    e.index(docs)
    found = e.retrieve(asked, 3)
    assert found.columns == engines.FOUND
    best = {r.query_id: r.doc_id for r in found.where("rank = 1").collect()}
    assert best[1] == 1
    # a walk from whatever facts are nearest need not start at a passage without entities
    assert best[2] == 2 if kind is not engines.FactGraphEngine else 2 in {r.doc_id for r in found.where("query_id = 2").collect()}


def test_evaluation(spark, corpus, tmp_path):
    docs, asked = corpus
    e = engines.LexicalEngine(spark, str(tmp_path), chunk_words=20)
    e.index(docs)
    proofs = spark.createDataFrame([(1, 1, "Bohr lived in Copenhagen."), (2, 2, "nothing like this")], "proof_id long, query_id long, proof string")
    log = engines.evaluate(e, asked, proofs, "r").withColumn("row_no", F.monotonically_increasing_id())
    assert runlog.recall_at_k(log, [5]).first().recall_5 == 50.0
    assert runlog.accuracy(log).first().accuracy == 50.0


def test_no_retrieval(spark, corpus, tmp_path):
    docs, asked = corpus
    e = engines.NoRetrieval(spark, str(tmp_path))
    assert e.retrieve(asked).count() == 0 and e.generate(asked, e.retrieve(asked)).count() == 2


def test_vector_engine_is_brute_force(spark, tmp_path):
    """The engine's scores by rank are those of all chunks against all questions in numpy."""
    import numpy as np

    from quillon.functions.models import hashed_vector

    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["oak", "elm", "ash", "fir", "yew", "bay", "fig"], int(rng.integers(1, 70)))) for _ in range(40)]
    e = engines.VectorEngine(spark, str(tmp_path), chunk_words=20)
    e.index(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"))
    asked = [(i, f"{t[:20]} elm") for i, t in enumerate(texts[:6])]
    got = {(r.query_id, r["rank"]): r.score for r in e.retrieve(spark.createDataFrame(asked, "query_id long, question string"), 7).collect()}
    chunks = [t.split()[i : i + 20] for t in texts for i in range(0, len(t.split()), 20)]
    matrix = np.array([hashed_vector(" ".join(c)) for c in chunks])
    for i, q in asked:
        best = np.sort(matrix @ np.array(hashed_vector(q)))[::-1][:7]
        np.testing.assert_allclose([got[i, n] for n in range(1, 8)], best, atol=1e-6)
    assert len(got) == 42
