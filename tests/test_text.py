import pytest
from pyspark.sql import functions as F

from quillon.functions import evaluation as E
from quillon.functions import text as T
from quillon.functions import vectors as V
from quillon.operators import segment as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, f, want", [
    ("The  Cat, a dog!", T.normalized_answer, "cat dog"),
    ("Answer: B.", T.mc_label, "B"),
    ("none", T.mc_label, "none"),
    ("", T.estimated_tokens, 0),
    ("a b c", T.estimated_tokens, 4),
    ("AND", T.is_valid_entity, False),
    ("x", T.is_valid_entity, False),
    ("--", T.is_valid_entity, False),
    ("U2", T.is_valid_entity, True),
    ("song\\ref{x} of", T.without_refs, "song\\ of"),
    ("song\\ref{x} of", T.refs, ["x"]),
    ("PER", T.entity_type, "Person"),
    ("OTHER", T.entity_type, "OTHER"),
    (None, T.tokens, None),
    ("https://www.a.org:80/b?c", T.domain, "a.org:80"),
    ("/wiki/A%20B#c?d", T.href_part, "A B"),
    ("2023-09-28T12:00", T.publication_year, "2023"),
    ("x <think>a\nb</think>y", T.without_thoughts, "x y"),
    ("One. Two!  Three", T.sentences, ["One.", "Two!", "Three"]),
    ("treatment of Hepatitis", T.biomedical_keywords, ["treatment", "hepatitis"]),
])
def test_scalars(spark, value, f, want):
    got = one(spark, value, f)
    assert (list(got) if isinstance(got, list) else got) == want


@pytest.mark.parametrize("seconds, want", [(8460, "2h 21m"), (45, "45s"), (0, "0s"), (3600, "1h")])
def test_duration(spark, seconds, want):
    assert spark.range(1).select(T.duration(F.lit(seconds))).first()[0] == want


def test_triplets(spark):
    got = one(spark, "{'a','b','c'} x {' d ','e','f'}", T.parsed_triplets)
    assert [tuple(r) for r in got] == [("a", "b", "c"), ("d", "e", "f")]


def test_python_helpers():
    assert T.close_json('{"a": [1, {"b": "c') == '{"a": [1, {"b": "c"}]}'
    assert T.title_slug(" A/B  C:") == "A_B_C" and T.title_slug("") == "UNTITLED" and len(T.title_slug("é" * 300).encode()) <= 200
    assert T.decode_escapes("\\u00e9 \\ud83d\\ude00 \\ud83d") == "é 😀 \\ud83d"
    assert T.sections("x\n[[ ## a ## ]]\n1\n2\n[[ ## b ## ]]\n3") == {"a": "1\n2", "b": "3"}
    assert T.html_text('<p>A <a href="/w/B_c">b</a> , d</p>') == "A b ref{B c}, d"
    assert T.relation_triples("<s>tp_XX<triplet> A b <per> C <loc> born in</s>") == [{"head": "A b", "head_type": "per", "type": "born in", "tail": "C", "tail_type": "loc"}]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("electricity", "electr"), ("running", "run"), ("adjustment", "adjust")])
def test_stem(word, want):
    assert E.stem(word) == want


def test_rouge():
    assert E.rouge_l_score("the cat sat", "the cat sat") == 1
    assert E.rouge_l_score("", "x") == 0
    assert E.rouge_l_score("police killed the gunman", "police kill the gunman") == 1


@pytest.mark.parametrize("said, want", [("yes", "correct"), ("a", "correct"), ("b", "wrong"), ("maybe", "formatting_error")])
def test_correctness(spark, said, want):
    labels, texts = F.array(F.lit("A"), F.lit("B")), F.array(F.lit("Yes"), F.lit("No"))
    assert spark.range(1).select(E.correctness(F.lit(said), F.lit("A"), labels, texts)).first()[0] == want


def test_grounding(spark):
    words = " ".join(f"w{i}" for i in range(9))
    proofs = spark.createDataFrame([(1, 1, "a b c"), (2, 1, words), (3, 1, "a c")], "proof_id int, question_id int, proof string")
    chunks = spark.createDataFrame([(1, 0, "x a b"), (1, 1, "z a b c"), (1, 2, "q w1 w2 w3 w4 w5 w6 w7 w8")], "question_id int, rank int, text string")
    assert {r.proof_id: r["rank"] for r in E.ground_proofs(proofs, chunks).collect()} == {1: 1, 2: 2, 3: -1}


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(["w"] * 2401)), (2, ""), (3, None)], "doc_id long, text string")
    rows = S.word_chunks(docs).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == ["1_0000", "1_0001", "1_0002"] and rows[-1].text == "w"


def test_contextual_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c. d e f. g h.")], "doc_id long, text string")
    got = [r.text for r in S.contextual_chunks(docs, 6, 4, 6, 1).orderBy("chunk_no").collect()]
    assert got == ["a b c. d e f.", "f. g h."]
    with pytest.raises(ValueError):
        S.contextual_chunks(docs, 1, 2, 3, 1)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.norm(F.col("a")).alias("n"), V.normalized(F.col("b")).alias("z"), V.is_sound(F.col("a"), 3).alias("s"), V.distance("L1", F.col("a"), F.col("b")).alias("d")).first()
    assert (r.n, r.z, r.s, r.d) == (5.0, [0.0, 0.0], False, 7.0)
