import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quillon.llm import queries, simhash
from tests.llm.test_llm import leaks_brute, lines_brute, words

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_stages(spark, tmp_path):
    """Each stage's own decisions take effect on what came before, and columns stay."""
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert docs.columns == first.columns
            seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[1] == seen[2] >= seen[3] > seen[4] > 0
    kept = spark.read.parquet(str(tmp_path / "benchmark_decontamination")).select("doc_id").distinct().count()
    assert docs.select("doc_id").distinct().count() == kept
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_stages_are_brute_force(spark, tmp_path):
    """What each stage keeps, from plain definitions over what its predecessor kept: a leaked item in many documents,
    repeated lines, copies, nulls, empty texts and repeated rows."""
    rng = np.random.default_rng(23)
    item, line = words(rng, 24, 300), "A line that many of these documents repeat, word for word"
    letters = ["abcde", "defgh"]
    rows = []
    for i in range(90):
        text = words(rng, int(rng.integers(20, 60)), 300, letters[i % 2])
        text += f"\n{line}" if i % 4 == 0 else f"\nno{i} {item}" if i % 9 == 1 else ""
        rows.append((i, text, "ab"[i % 2], "s", len(text)))
    rows += [(100 + i, rows[i][1] + "!" * (i % 2), *rows[i][2:]) for i in range(1, 40, 4)]
    rows += [(200, None, "a", "s", 0), (201, "", None, "s", 0), (202, "Ж" * 30 + " жжж ццц щщщ", None, "s", 0), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, str(tmp_path))
        if now.columns == docs.columns:
            docs = spark.createDataFrame(now.collect(), docs.schema)
            kept.append(sorted((r.doc_id, r.text) for r in docs.collect()))
        else:
            packed = now.collect()
    start = sorted((r[0], r[1]) for r in rows if r[1] and r[0] < 200)
    assert kept[0] == start
    lines = lines_brute(list({d: (d, t) for d, t in kept[0]}.values()))
    assert kept[1] == sorted((d, "\n".join(lines[d])) for d, _ in kept[0])
    prints = {d: simhash.fingerprint(t) for d, t in kept[1]}
    root = {d: d for d in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert kept[2] == [(d, t) for d, t in kept[1] if root[d] == d] and len(kept[2]) < len(kept[1])
    leaks = {kept[2][i][0] for i, _ in leaks_brute([t for _, t in kept[2]], [item])}
    assert kept[3] == [(d, t) for d, t in kept[2] if d not in leaks] and len(leaks) >= 8
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((d, len(t.encode(x, add_special_tokens=False).ids) + 1) for d, x in kept[3])
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path, rows)).count() == len(packed)


def _tables(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_empty_tables(spark, tmp_path):
    folder = _tables(spark, tmp_path, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
