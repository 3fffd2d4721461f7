"""Small cases of the training-data operators, each against brute force, an exact round trip or held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, common, components, decontam, langid, line_dedup, packing, sharding, simhash, token_counts, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(rng, n, size=40, letters="abcdefgh"):
    vocab = ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(size)]
    return " ".join(rng.choice(vocab, n))


# line dedup


def lines_brute(texts, least=40, most=5):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    split = {i: (t or "").split("\n") for i, t in texts}
    held = {}
    for i, own in split.items():
        for line in own:
            held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= most}
    return {i: [line for line in own if gone.get(key(line), i) == i] for i, own in split.items()}


def test_line_dedup(spark):
    long, accent = "This line is repeated and has over forty letters", "Ünïcode ÄÖ line that is repeated in many documents É"
    texts = [f"own {i}\n{long if i % 2 else '  ' + long.upper()}\n{accent if i < 6 else accent.lower()}\nshort\n" for i in range(8)] + [None, "", long + "\n" + long, "\n\n", "İ" * 45]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    want = lines_brute(list(enumerate(texts)))
    assert {i: r.text for i, r in out.items()} == {i: "\n".join(x) for i, x in want.items()}
    assert all(r.n_lines - r.n_dropped == len(want[i]) for i, r in out.items())
    assert out[8].n_lines == 1 and set(out[0].asDict()) >= {"lang", "source", "n_chars"}


def test_line_dedup_hot_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    hot, warm = "x" * 50, "y" * 50
    texts = [f"{hot}\n{i}\n" + (warm if i % 7 == 0 else "z") for i in range(60)]
    df = docs_of(spark, texts)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df.unionByName(df.where("doc_id < 3"))).collect()}
    assert out == {i: "\n".join(x) for i, x in lines_brute(list(enumerate(texts))).items()}
    assert line_dedup.dedup_lines(df.unionByName(df.where("doc_id < 3"))).count() == 63
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# sharding


def test_sharding(spark):
    texts = [None, ""] + ["é" * (i % 50) for i in range(998)]
    df = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("source")))
    rows = sharding.assign_shards(df, 40).collect()
    counts = np.bincount([r.shard for r in rows], minlength=40)
    assert len(rows) == 1000 and counts.max() - counts.min() <= 1
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        hot = sum(r.source == "hot" for r in rows if r.shard == s)
        assert abs(hot - 334 / 40) <= 2
    assert all(r["size"] == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(df.repartition(7), 40).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    twice = sharding.assign_shards(df.where("doc_id < 5").unionByName(df.where("doc_id < 5")), 3).collect()
    assert sorted((r.shard, r.slot) for r in twice) == sorted((s, i) for s in range(3) for i in range(4 if s == 0 else 3))
    assert sharding.assign_shards(df.limit(0), 40).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert sharding.assign_shards(nulls, 4).where("shard is null or slot is null").count() == 0


def shards_brute(rows, shards, seed=5):
    """(doc_id, crc) to (shard, slot), for rows (doc_id, text, source), all different."""
    by = {}
    for d, t, s in rows:
        crc = zlib.crc32((t or "").encode())
        key = hashlib.md5(f"{seed}|{'' if d is None else d}|{crc}".encode()).hexdigest()
        by.setdefault("n" if s is None else "s" + s, []).append((key, -1 if d is None else d, len((t or "").encode()) + 16, crc))
    return by


def test_sharding_is_brute_force(spark):
    """The whole order from the definition; very many sources of one row spread over all shards; clashing columns."""
    rng = np.random.default_rng(18)
    rows = [(i, str(rng.integers(0, 9)) * int(rng.integers(0, 5)), f"s{i}" if i % 2 else None if i % 10 == 0 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(-1) for c in ("shard", "slot", "size", "text_crc32", "rank", "bucket")}).repartition(5)
    names = {r.s: r.h for r in spark.createDataFrame([(k,) for k in shards_brute(rows, 40)], "s string").select("s", F.pmod(F.xxhash64(F.lit(5), "s"), F.lit(1 << 20)).alias("h")).collect()}
    order = []
    for name, own in shards_brute(rows, 40).items():
        for rank, row in enumerate(sorted(own), 1):
            order.append(((rank - (names[name] + 0.5) / (1 << 20)) / len(own), *row[:3], name))
    want = {}
    for at, row in enumerate(sorted(order)):
        shard = at * 40 // len(order)
        want[row[2]] = (shard, at - -(-shard * len(order) // 40))
    got = sharding.assign_shards(df, 40).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    assert all((r.rank, r.bucket, r.text) == (-1, -1, rows[r.doc_id][1]) for r in got)
    alone = np.bincount([r.shard for r in got if r.doc_id % 2], minlength=40)
    assert alone.min() > 15 and "text" not in sharding.assign_shards(df, 40, texts=False).columns


# chat


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "system", "be <| kind <||"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", "é<"), (2, 0, "assistant", "x"), (3, 1, None, None), (3, 0, "user", "q"), (None, 0, "user", "n"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    t = chat.Template()
    text = {}
    for r in sorted(chat.segments(df).collect(), key=lambda r: (r.conv_id or -9, r.turn_no, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.segment
    back = {k: [tuple(map(t.unescape, m)) for m in re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", v, re.S)] for k, v in text.items()}
    want = {}
    for c, n, role, x in sorted(rows, key=lambda r: (r[0] or -9, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", x or ""))
    assert back == want
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    for c, turns in want.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars, got[c].n_turns) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text[c]), len(turns))
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: False}
    assert chat.digests(df.limit(0)).count() == 0


def test_chat_ids_and_marks(spark):
    """Ids beyond the doubles' whole numbers beside a null id, and roles and texts made of marks."""
    rows = [(None, 0, "user", "n")] + [(2**53 + i, t, r, x) for i in range(2) for t, (r, x) in enumerate([("user", f"q{i}"), ("assistant", "<|n<||n\n"), ("a\nb<|\n<", "<|im_end|>\n<|im_start|>")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {None: 1, 2**53: 3, 2**53 + 1: 3}
    for c, r in got.items():
        own = [x for x in rows if x[0] == c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(x[3] for x in own if x[2] == "assistant").encode()).hexdigest()
    assert {r.conv_id for r in chat.segments(df).collect()} == set(got)


# packing and token counts


def test_packing(spark):
    rng = np.random.default_rng(0)
    texts = [words(rng, int(n)) for n in rng.integers(0, 300, 120)] + [None, "", words(rng, 2500), "<|endoftext|> a", "don't STOP’s\x1cx \x85y"]
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    packed = packing.pack(docs_of(spark, texts), path, 512, with_ids=True)
    rows = packed.collect()
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        assert [(r.start, r.length) for r in own] == [(a, min(512, len(ids) - a)) for a in range(0, len(ids), 512)]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in own)
    total = sum(r.length for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 512
    assert len(by) <= -(-total // 512) * 1.1 + 2
    assert {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()} == {k: sum(n for _, n in v) for k, v in by.items()}
    assert packing.pack(docs_of(spark, texts).limit(0), path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 20_000).astype(int) + 1)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    plan = packing.Plan(dict(histogram), 4096)
    used = {}
    for own, made in plan.groups:
        assert sum(own) <= 4096
        for n in own:
            used[n] = used.get(n, 0) + made
    assert used == histogram
    assert plan.sequences <= -(-lengths.sum() // 4096) * 1.005 + 1


def test_nnls():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(a, np.array([3.0, 5.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 5])


def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(1)
    texts = [None, "", "  \n ", "Ünï 漢字 😀 <s> <0x0A> ▁x", "a" * 300, *[words(rng, 30, letters="etaoinshé漢") for _ in range(20)]]
    t = Tokenizer(models.Unigram(token_counts.vocabulary(model), 0, True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")])
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(spark, texts), model).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_token_ties():
    from tokenizers import Tokenizer, models

    rng = np.random.default_rng(2)
    for _ in range(20):
        pieces = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(8)})
        vocab = [("<unk>", -1.0), *((p, -1.0 * len(p)) for p in pieces)]
        t, own = Tokenizer(models.Unigram(vocab, 0, False)), token_counts.Counter(vocab)
        for _ in range(20):
            text = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
            assert own.count(text) == len(t.encode(text).ids), (text, vocab)


# SimHash


def test_simhash(spark):
    import xxhash

    rng = np.random.default_rng(3)
    base = [words(rng, 60, 300) for _ in range(30)]
    texts = base + [b.replace(" ", "  ").upper() for b in base[:5]] + [b + " tail" for b in base] + [None, "", "one two", "ONE TWO", " \n"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fp = {}
    for i, x in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    root = {i: i for i in fp}
    for i in sorted(fp):
        for j in sorted(fp):
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_anchors_cover():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 3000, np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    i, a = simhash.anchors_of(x)
    j, b = simhash.anchors_of(y)
    left, right = set(zip(i.tolist(), a.tolist(), strict=True)), set(zip(j.tolist(), b.tolist(), strict=True))
    assert {k for k, _ in left & right} == set(range(len(x)))


def test_split_anchors_cover():
    rng = np.random.default_rng(20)
    x = rng.integers(0, 2**63, 2000, np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 63, len(y)).astype(np.uint64)
    met = []
    for v in (x, y):
        i, a = simhash.anchors_of(v)
        j, b = simhash.split_anchors(a, v[i])
        met.append(set(zip(i[j].tolist(), b.tolist(), strict=True)))
    assert {k for k, _ in met[0] & met[1]} == set(range(len(x)))


@pytest.mark.parametrize("dense", [3, 40])
def test_simhash_of_dense_anchors(spark, monkeypatch, dense):
    """Fingerprints that crowd at few anchors, which are split, give the components of all pairs."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(19)
    seeds = rng.integers(0, 2**63, 12, np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 6)), replace=False)) for s in seeds for _ in range(60)}
    fps = sorted(fps | {int(rng.integers(0, 2**63)) for _ in range(100)})
    root = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3), 4)
    got = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert got == {f: r for f, r in root.items() if r != f or list(root.values()).count(f) > 1}


def test_linked_joins_everything():
    fps = np.array([0, 1, 3, 7, 15, 31, 63, 2**63, 2**63 + 1, 2**40 * 0xFFFF], np.uint64)
    assert len(simhash.linked(fps, 1)) == 8


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100)] + [(int(a), int(b)) for a, b in rng.integers(200, 400, (150, 2))] + [(500, 500), (601, 600), (600, 601), (None, 7)]
    root = {}
    find = lambda v: v if root.setdefault(v, v) == v else find(root[v])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {v: find(v) for v in root}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# embeddings


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((60, 16))
    x = np.vstack((centers, centers[:20] + 0.05 * rng.standard_normal((20, 16)), centers[0] + 0.1 * rng.standard_normal((150, 16)), centers[1:3])).astype(np.float32)
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [], [1.0, 2.0]]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, v, 1) for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    root = np.arange(len(x))
    for _ in range(len(x)):
        now = np.array([root[near[i]].min() for i in range(len(x))])
        if (now == root).all():
            break
        root = now
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all((r.n_links, r.component_id, r.kept) == (0, i, True) for i, r in got.items() if i >= 1000)
    assert len(got) == len(rows)


def test_embeddings_ids_and_norms(spark):
    """Null and repeated ids, rows that share an id and not the vector, repeated rows, and norms whose squares overflow or vanish."""
    a, b, c = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0], [-1.0, 2.0, 7.0]
    scaled = lambda v, k: [k * x for x in v]
    rows = [(5, a), (5, b), (3, scaled(a, 1e200)), (None, a), (7, a), (7, a), (9, scaled(b, 1e-200)), (None, c), (4, scaled(a, 5e-324)), (8, None)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, node string")
    got = sorted(vectors.near_duplicates(df).collect(), key=str)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    want = []
    for i, v in rows:
        near = [] if v is None else [j for j, w in rows if w is not None and unit(v) @ unit(w) >= 0.95]
        least = min((j for j in near if j is not None), default=None) if near else i
        want.append((i, max(0, len(near) - 1), least, i == least))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_joined_is_brute_force():
    rng = np.random.default_rng(14)
    x = rng.standard_normal((300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for split in (None, 100):
        near = x @ x.T >= 0.995
        if split:
            near[:split, :split] = near[split:, split:] = False
        root = np.arange(300)
        while True:
            now = np.array([min([root[i], *root[near[i]]]) for i in range(300)])
            if (now == root).all():
                break
            root = now
        assert (vectors._joined(x, split, 0.995) == root).all()


def test_components_of_hubs(spark, monkeypatch):
    """Stars whose hubs are broadcast, one of them with the greatest number, and a chain between them."""
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    edges = [(0, i) for i in range(1, 3000)] + [(9999, i) for i in range(4000, 5000)] + [(2999, 3500), (3500, 4000), (7000, 7001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()}
    assert got == {v: 7000 if v in (7000, 7001) else 0 for e in edges for v in e}


def test_embeddings_of_a_crowded_star(spark):
    """Many copies that link to one vector and hardly to each other: what brute force links is found, but for the recall at the threshold."""
    rng = np.random.default_rng(13)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base, far = unit(rng.standard_normal(64)), unit(rng.standard_normal((2000, 64)))
    off = rng.standard_normal((2000, 64))
    off = unit(off - (off @ base)[:, None] * base)
    x = np.vstack((base[None], 0.955 * base + np.sqrt(1 - 0.955**2) * off, far)).astype(np.float32)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)).collect()}
    u = unit(x.astype(float))
    links = (u @ u.T >= 0.95).sum(1) - 1
    linked = np.flatnonzero(links)
    assert len(linked) == 2001 and len(got) == len(x)
    assert np.mean([got[i].component_id == 0 for i in linked]) >= 0.99 and got[0].n_links >= 0.99 * links[0]
    assert sum(got[i].n_links for i in linked) >= 0.99 * links.sum()
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(len(x)) if not links[i])


# language ID


def corpora(rng, n):
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "éçàou"}
    return [(words(rng, int(rng.integers(3, 40)), 200, letters), lang) for lang, letters in kinds.items() for _ in range(n)]


def test_language_id(spark):
    rng = np.random.default_rng(7)
    pairs = corpora(rng, 60)
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(pairs)] + [(900, None, "aa", "s", 0), (901, "", None, "s", 0), (902, "12 ½ --", "aa", "s", 0), (903, "жук жёлтый", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [i for i in range(len(pairs)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and np.mean([got[i].lang_pred == pairs[i][1] for i in held]) > 0.95
    assert not any(got[i].rejected for i in range(len(pairs))) and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902))
    assert got[903].lang_pred in ("aa", "bb", "cc") and got[903].rejected
    odd = df.unionByName(df.where("doc_id < 3")).unionByName(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.withColumns({c: F.lit(c) for c in ("best", "own", "row", "next", "events", "score", "apart", "most")})
    out = langid.identify(odd).collect()
    assert len(out) == len(rows) + 4 and all(r.best == "best" and r.row == "row" and r.most == "most" and 0 <= r.score <= 1 for r in out)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def kneser_ney(texts):
    """Cross-entropies by the definition, from dictionaries: texts are (text, lang); gives a function of a text."""
    counts, letters = {}, set()
    for text, lang in texts:
        for word in langid.words_of(text):
            marked = langid.START + word + langid.END
            letters |= set(marked[1:])
            for i in range(1, len(marked)):
                g = marked[max(0, i - 3) : i + 1]
                counts.setdefault(lang, {}).setdefault(len(g), {}).setdefault(g, 0)
                counts[lang][len(g)][g] += 1
    tables = {}
    for lang, own in counts.items():
        level = {4: own.get(4, {})}
        for n in (3, 2, 1):
            level[n] = dict(own.get(n, {}))
            for g in level[n + 1]:
                level[n][g[1:]] = level[n].get(g[1:], 0) + 1
        tables[lang] = level

    def probability(level, g):
        if not g:
            return 1 / (len(letters) + 1)
        own = level[len(g)]
        after = [v for k, v in own.items() if k[:-1] == g[:-1]]
        ones, twos = (sum(v == k for v in own.values()) for k in (1, 2))
        d = min(0.9, max(0.1, ones / max(ones + 2 * twos, 1)))
        if not after:
            return probability(level, g[1:])
        return max(own.get(g, 0) - (d if g in own else 0), 0) / sum(after) + min(1, d * len(after) / sum(after)) * probability(level, g[1:])

    def entropy(text):
        out = {}
        for lang, level in tables.items():
            each = [-np.log(probability(level, m[max(0, i - 3) : i + 1])) for w in langid.words_of(text) for m in [langid.START + w + langid.END] for i in range(1, len(m))]
            out[lang] = np.mean(each) if each else None
        return out

    return entropy


@pytest.mark.parametrize("entries", [1 << 23, 300])
def test_language_models_are_brute_force(spark, monkeypatch, entries):
    """The whole query's predictions, and the entropies behind them, from the definition; also where languages take several passes."""
    monkeypatch.setattr(langid, "ENTRIES", entries)
    rng = np.random.default_rng(15)
    pairs = corpora(rng, 15) + [("zzz zz zyx", "dd"), ("é", "cc")]
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(pairs)], DOCS)
    taught = [p for i, p in enumerate(pairs) if zlib.crc32(str(i).encode()) % 5]
    entropy = kneser_ney(taught)
    counts = langid.gram_counts(spark.createDataFrame(taught, "text string, lang string").withColumn("apart", F.lit(False)))
    blocks = langid.fit(counts)
    assert len(blocks) == (1 if entries > 300 else 4)
    for r in langid.entropies(df, blocks).collect():
        want = sorted((v, k) for k, v in entropy(r.row.text).items())
        assert r.best == want[0][1] and r.own == pytest.approx(want[0][0], rel=1e-5) and r.next == pytest.approx(want[1][0], rel=1e-5)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert got == {i: min((v, k) for k, v in entropy(t).items())[1] for i, (t, _) in enumerate(pairs)}


# toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for i in range(500):
        own = words(rng, int(rng.integers(5, 60)), 200).split()
        if i % 4 == 0:
            for w in ("vilex", "nastu", "vilexa"):
                own.insert(int(rng.integers(0, len(own))), w)
        texts.append(" ".join(own))
        labels.append(int(i % 4 == 0))
    df = docs_of(spark, [*texts, None, "", "vilex nastu vilexa " + words(rng, 3000)])
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, marks)
    got = {r.doc_id: r for r in toxicity.score(df, net).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    pos, neg = (np.array([got[i].score for i in held if labels[i] == v]) for v in (1, 0))
    assert (pos[:, None] > neg[None]).mean() > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[500].score == got[501].score and got[502].score > 0.3
    assert toxicity.score(df.limit(0), net).count() == 0
    assert toxicity.score(df, toxicity.fit(df, marks.limit(0))).count() == 503


def test_toxicity_scores_are_brute_force(spark):
    """Every score of the query from the net's numbers, word by word; repeated ids teach once."""
    rng = np.random.default_rng(21)
    texts = [words(rng, int(rng.integers(0, 30)), 60) + (" vilex nastu" if i % 3 == 0 else "") for i in range(90)] + [None, "x"]
    df = docs_of(spark, texts)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    net = toxicity.fit(df.unionByName(df.where("doc_id < 40")), marks)
    assert (net.embed == toxicity.fit(df, marks).embed).all()

    def brute(text):
        own = [net.embed[toxicity.slots_of([w])[0]].sum(axis=0) for w in toxicity.words_of(text)] + [np.zeros(toxicity.DIM)] * toxicity.PADS
        block, hidden = 0, []
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                each = [sum(own[p + j] @ net.filters[:, (block + j) * toxicity.FILTERS + f] for j in range(width)) for p in range(len(own) - toxicity.PADS + 1)]
                hidden.append(max(0, max(each) + net.bias[width * toxicity.FILTERS - toxicity.FILTERS + f]))
            block += width
        return 1 / (1 + np.exp(-(net.scale[0] * (np.array(hidden) @ net.out + net.shift) + net.scale[1])))

    got = {r.doc_id: r.score for r in toxicity.score(df, net).collect()}
    assert got == pytest.approx({i: brute(t) for i, t in enumerate(texts)}, abs=1e-4)


def test_pooling_in_spans_is_the_same():
    rng = np.random.default_rng(9)
    net = toxicity.Net(rng.normal(size=(toxicity.SLOTS, toxicity.DIM)).astype(np.float32), rng.normal(size=(toxicity.DIM, toxicity.BLOCKS * toxicity.FILTERS)).astype(np.float32), np.zeros(24, np.float32), np.zeros(24, np.float32), 0.0)
    texts = [[f"w{k}" for k in rng.integers(0, 50, n)] for n in (0, 1, 2, 7, 100, 0, 33)]
    index = common.WordIndex()
    rows, lengths = toxicity._flat(texts, index)
    table = np.pad(net.project(toxicity.slots_of(list(index))), ((0, 1), (0, 0)))
    whole = net.pooled(rows, lengths, table)
    assert np.allclose(whole, net.pooled(rows, lengths, table, span=5)) and np.isfinite(whole).all()
    p = net.project(toxicity.slots_of(texts[3]))
    f = toxicity.FILTERS
    pad = np.pad(p, ((0, 3), (0, 0)))
    three = max(range(8), key=lambda i: pad[i, 3 * f] + pad[i + 1, 4 * f] + pad[i + 2, 5 * f])
    assert whole[3, 2 * f] == pytest.approx(pad[three, 3 * f] + pad[three + 1, 4 * f] + pad[three + 2, 5 * f])


# decontamination


def test_decontamination(spark):
    rng = np.random.default_rng(10)
    items = [words(rng, int(n), 400, "abcdefghijklmnop") for n in rng.integers(15, 60, 25)]
    clean = [words(rng, int(n), 400, "abcdefghijklmnop") for n in rng.integers(1, 400, 60)]
    leaky = [f"{words(rng, int(rng.integers(0, 90)), 400)} {x} {words(rng, 50, 400)}" for x in items]
    para = []
    for x in items[:10]:
        own = x.split()
        own[:: max(6, len(own) // 3)] = ["changed"] * len(own[:: max(6, len(own) // 3)])
        para.append(f"{words(rng, 40, 400)} {' '.join(own)} end")
    df = docs_of(spark, [*clean, *leaky, *para, None, ""])
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "--")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()}
    assert got == {(60 + i, i) for i in range(25)} | {(85 + i, i) for i in range(10)}
    assert decontam.find_leaks(df.limit(0), bench).count() == 0 and decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_lcs():
    rng = np.random.default_rng(11)
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(0, 20)), rng.integers(0, 5, rng.integers(0, 20))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.lcs(a, b) == t[-1, -1]


def test_sums_of_runs_of_rows():
    rng = np.random.default_rng(5)
    values = rng.standard_normal((50, 3)).astype(np.float32)
    for sizes in ([1], [1, 1, 1], [700, 1, 64, 65, 128, 3], rng.integers(1, 200, 40).tolist()):
        at, weights = rng.integers(0, 50, sum(sizes)), rng.random((sum(sizes), 1)).astype(np.float32)
        starts = np.cumsum(sizes) - sizes
        for w in (None, weights):
            rows = values[at].astype(float) * (1 if w is None else w)
            plain = [rows[a : a + n].sum(axis=0) for a, n in zip(starts, sizes, strict=True)]
            np.testing.assert_allclose(decontam.sum_rows(values, at, w, starts), plain, atol=1e-3)


def test_decontamination_of_common_items(spark):
    """An item in very many documents, whose words are thereby common, is found in all of them, also with words changed."""
    rng = np.random.default_rng(12)
    hot = words(rng, 36, 400, "abcdefghijklmnop")
    rare = [words(rng, 30, 400, "abcdefghijklmnop") for _ in range(5)]
    changed = hot.split()
    changed[::6] = ["changed"] * len(changed[::6])
    texts = [f"{words(rng, 30, 400)} {' '.join(changed) if i % 3 == 0 else hot} {words(rng, 30, 400)}" for i in range(120)]
    texts += [f"{words(rng, 20, 400)} {x}" for x in rare] + [words(rng, 80, 400) for _ in range(60)]
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs_of(spark, texts), spark.createDataFrame([*enumerate([hot, *rare])], "item_id long, text string")).collect()}
    assert got == {(i, 0) for i in range(120)} | {(120 + i, 1 + i) for i in range(5)}


def leaks_brute(texts, items, similarity=0.8, loose=0.6):
    """All documents against all items: the longest common subsequence with every region that the operator could look at."""
    out = set()
    for d, text in enumerate(texts):
        doc = decontam.words_of(text)
        for i, item in enumerate(items):
            words, answer, size = decontam.words_of(item), decontam.answer_of(item), 8.0
            if not words:
                continue
            while size < len(words):
                size *= decontam.GROWTH
            size = int(size)
            numbers = {w: n for n, w in enumerate(words)}
            own, answer = np.array([numbers[w] for w in words]), [numbers[w] for w in answer]
            step = decontam.grid(size)[0]
            for k in range(-(3 * size // step), len(doc) // step + 1):
                s = k * step - size // 2
                region = [numbers[w] for w in doc[max(0, s) : max(0, s + 2 * size)] if w in numbers]
                share = decontam.lcs(own, np.array(region, np.int64)) / len(words)
                if share >= similarity or (share >= loose and len(answer) >= 3 and decontam._holds(region, answer)):
                    out.add((d, i))
                    break
    return out


def test_decontamination_is_brute_force(spark):
    """An item in half of all documents, one of common words only, short and long ones, paraphrases, answers, repeated rows."""
    rng = np.random.default_rng(16)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(400)]
    say = lambda n, of=400: " ".join(rng.choice(vocab[:of], n))
    items = [say(36), say(20, 12), say(4), say(90), f"{say(12)}? {say(5)}", say(30), say(30), say(9)]
    texts = []
    for n in range(160):
        parts = [say(int(rng.integers(0, 60)), 400 if n % 3 else 40)]
        if n % 2:
            parts.append(items[0])
        if n % 8 == 0:
            own = items[int(rng.integers(0, len(items)))].split()
            for at in rng.choice(len(own), int(rng.integers(0, max(1, len(own) // 3))), replace=False):
                own[at] = str(rng.choice(["x", "", say(2)]))
            parts.append(" ".join(own))
        if n % 10 == 5:
            own = items[1].split()
            parts.append(" ".join(own[:10] + [say(3)] + own[10:]))
        if n == 77:
            parts.append(f"{items[4].split('?')[0][:30]} {items[4].split('? ')[1]}")
        parts.append(say(int(rng.integers(0, 60))))
        texts.append(" ".join(parts))
    df, bench = docs_of(spark, texts), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    want = leaks_brute(texts, items)
    every = decontam.find_leaks(df, bench).collect()
    rows = [r for r in every if r.path == "sequence"]
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and sum(i == 0 for _, i in want) >= 80
    # what the latent search adds are the texts that hold a good part of an item
    more = {(r.doc_id, r.item_id) for r in every if r.path == "latent"}
    assert len(rows) + len(more) == len(every) and more <= leaks_brute(texts, items, similarity=0.4, loose=0.3) - want
    assert len({i for _, i in want}) >= 6
    again = decontam.find_leaks(df.unionByName(df).repartition(7), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in again if r.path == "sequence") == sorted(2 * [(r.doc_id, r.item_id, r.similarity, r.start) for r in rows])


def test_decontamination_in_blocks(spark, monkeypatch):
    """Items and vocabularies taken a few at a time find the same."""
    rng = np.random.default_rng(17)
    items = [words(rng, 25, 400) for _ in range(9)]
    df = docs_of(spark, [f"{words(rng, 30, 400)} {x} {words(rng, 30, 400)}" for x in items * 2])
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    monkeypatch.setattr(decontam, "ITEMS", 2)
    monkeypatch.setattr(decontam, "VOCABULARY", 60)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench).collect()} == {(i, i % 9) for i in range(18)}


def paraphrased(rng, item, kind, vocab):
    own = item.split()
    if kind == "swapped":
        return " ".join(own[len(own) // 2 :] + own[: len(own) // 2])
    for at in rng.choice(len(own), round(0.45 * len(own)), replace=False):
        own[at] = str(rng.choice(vocab))
    return " ".join(own)


def test_decontamination_of_paraphrases(spark):
    """Items of 30 words in texts of 150 with 45 % of words replaced or halves swapped: only the latent search finds them.

    Clean texts share the items' vocabulary. Verbatim copies are found with a cosine, so by the latent search as well.
    """
    rng = np.random.default_rng(31)
    vocab = np.array(["".join(rng.choice(list("abcdefghijkl"), rng.integers(4, 9))) for _ in range(3000)])
    weights = 1 / np.arange(1, len(vocab) + 1) ** 0.7
    say = lambda n: " ".join(rng.choice(vocab, n, p=weights / weights.sum()))
    items = [say(30) for _ in range(40)]
    inside = lambda x: f"{say(60)} {x} {say(60)}"
    texts = [inside(paraphrased(rng, x, kind, vocab)) for kind in ("swapped", "replaced") for x in items] + [inside(x) for x in items] + [say(150) for _ in range(600)]
    df, bench = docs_of(spark, texts), spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    rows = decontam.find_leaks(df, bench).collect()
    right = {(r.doc_id, r.item_id) for r in rows if r.doc_id < 120 and r.doc_id % 40 == r.item_id}
    latent = [r for r in rows if r.path == "latent"]
    assert sum(40 > d for d, _ in right) >= 36 and sum(80 > d >= 40 for d, _ in right) >= 34
    assert {(80 + i, i) for i in range(40)} <= right and len(rows) - len(right) <= 1
    assert all(r.cosine >= 0.6 for r in latent) and len(latent) >= 70
    assert sum(r.cosine >= 0.6 for r in rows if r.doc_id in range(80, 120)) >= 36
    off = decontam.find_leaks(df, bench, least=9).collect()
    assert not [r for r in off if r.path == "latent"] and {(r.doc_id, r.item_id) for r in off} == {(r.doc_id, r.item_id) for r in rows if r.path == "sequence"}


def test_decontamination_of_short_items(spark):
    """One- and two-word items are held by every document that has their words in order; they have no paraphrases."""
    df = docs_of(spark, ["one two three", "two one", "three", "nothing"])
    rows = decontam.find_leaks(df, spark.createDataFrame([(1, "one"), (2, "one two")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.path) for r in rows} == {(0, 1, "sequence"), (1, 1, "sequence"), (0, 2, "sequence")}


# rows that repeat, ids that are null or shared, and columns of any name


def test_odd_rows(spark):
    rng = np.random.default_rng(22)
    long = "this line is long enough to be a key of many documents"
    rows = [(i, f"{long}\n{words(rng, 8)}", "x", "x", -7, "x", "x") for i in range(6)] + [(None, long, "x", "x", -7, "x", "x"), (None, f"{long}\n{long}", "x", "x", -7, "x", "x"), (3, "other text", "x", "x", -7, "x", "x"), (8, None, "x", "x", -7, "x", "x"), (9, "", "x", "x", -7, "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string, h1 string, n_dropped int, drops string, bits string").repartition(3)
    df = df.unionByName(df)
    out = line_dedup.dedup_lines(df).collect()
    want = lines_brute([(-1 if r[0] is None else r[0], r[1]) for r in rows if r[1] != "other text"])
    for r in out:
        if r.text == "other text":
            assert r.doc_id == 3 and r.n_dropped == 0
        elif r.doc_id is None:
            assert r.text == "" and r.n_dropped == r.n_lines and r.line == "x"
        else:
            assert r.text == "\n".join(want[r.doc_id])
    assert len(out) == 2 * len(rows)
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(df, path, 64).collect()
    assert sum(r.doc_id is None for r in packed) == 4 and sum(r.doc_id == 8 for r in packed) == 2
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for a, n in own if a < o) for own in spans.values() for o, _ in own)
    counts = token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(counts) == len(out) and {r.n_tokens for r in counts if r.doc_id in (8, 9)} == {0}
    near = simhash.near_duplicates(df).collect()
    assert len(near) == len(out) and {r.component_id for r in near if r.doc_id in (8, 9)} == {8}
    prints = {r.fingerprint for r in near if r.doc_id is None}
    assert all(r.component_id is not None or r.fingerprint in prints for r in near)
