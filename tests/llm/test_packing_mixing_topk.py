import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import mixing, packing, topk
from framelake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


def plain_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [1]


ODD = [
    "", None, " \n ", "a<|endoftext|>b <|x it's don't. ÀÉ, é x İstanbul. ...,,, 12a34.  x y\x1cz 'S ΑΣ. 漢字、かな。   <|startoftext|>",
    ",", "ﬁ ½   á Å", "İİ I", "x" * 5_000, "Hello, hello! HELLO?",
]


def test_cached_ids_equal_the_tokenizers(path, spark, monkeypatch):
    documents = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    monkeypatch.setattr(packing, "CACHE", 50)  # so that the cache turns over
    encoder = packing.Encoder(path)
    texts = ODD + documents
    got = [np.frombuffer(b, dtype="<u4").tolist() for i in range(0, len(texts), 7) for b in encoder.encode(texts[i : i + 7])]
    assert [g + [1] for g in got] == [plain_ids(path, t) for t in texts]


def test_pieces_and_sequences_are_gapless_and_whole(spark, path):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(1, "again", "s"), (1, "again", "s"), (None, "no id", "s"), (90, "word " * 300, "s")]
    docs = spark.createDataFrame(rows, DOCS)
    cut = packing.pieces(docs, path, length=64)
    packed = packing.pack(cut, length=64, group=10).collect()
    wanted = sorted((repr(d), tuple(plain_ids(path, t))) for d, t, _ in rows)
    assert len(packed) == sum(math.ceil(len(ids) / 64) for _, ids in wanted)
    for r in packed:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length <= 64 and r.start == 64 * r.piece
        assert any(name == repr(r.doc_id) and list(whole[r.start : r.start + 64]) == ids for name, whole in wanted)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(docs.limit(0), path)).count() == 0


def fewest(lengths, size):
    """Brute force over the partitions of a few pieces."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1 :])
        place(i + 1, rooms + [size - lengths[i]])

    place(0, [])
    return best


def test_bin_completion_finds_the_fewest_sequences():
    rng = np.random.default_rng(11)
    won = 0
    for _ in range(60):
        lengths = rng.integers(8, 60, size=rng.integers(1, 10)).tolist()
        found = packing.complete(lengths, 100)
        assert sorted(itertools.chain(*found)) == sorted(lengths) and all(sum(b) <= 100 for b in found)
        assert len(found) == fewest(lengths, 100)
        won += len(packing.best_fit(lengths, 100)) > len(found)
    hard = [60, 60, 50, 50, 41, 41, 39, 39, 10, 10]
    assert len(packing.complete(hard, 100)) == fewest(hard, 100)
    assert packing.complete([], 100) == []


def test_dominance():
    assert packing.dominates((50,), (30, 20)) and packing.dominates((30, 20), (30, 20)) and packing.dominates((31, 20), (30, 20))
    assert not packing.dominates((30, 20), (50,)) and not packing.dominates((25, 25), (30, 20))


def shares(sizes, weights, share=1.5, most=2):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, full, target = share * sum(sizes.values()), set(), {}
    while True:
        open_ = [n for n in names if n not in full]
        left = budget - sum(most * sizes[n] for n in full)
        for n in open_:
            target[n] = left * weight[n] / sum(weight[m] for m in open_)
        above = {n for n in open_ if target[n] > most * sizes[n] * (1 + 1e-12)}
        for n in above:
            target[n] = most * sizes[n]
        full |= above
        if not above:
            return target


def test_targets_and_taken_words(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for source, n in (("b", 400), ("a", 900), (None, 60), ("ä", 300), ("c", 40)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * int(rng.integers(0, 40))), source))
            i += 1
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("mine"))
    got = mixing.mix(docs.repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == list(range(i))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = shares(sizes, mixing.WEIGHTS)
    taken = {}
    for r in got:
        assert r.size == len(r.text.split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 80
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    monkeypatch.setattr(mixing, "FEW", 1)  # the finest slices give the same cut
    monkeypatch.setattr(mixing, "SLICES", 4)
    again = mixing.mix(docs.repartition(3)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    copies = mixing.mixture(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.copies for r in got if r.copies}


def test_mixing_edges(spark):
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "\x1c x", None), (None, "y y", None), (None, "y y", None)], DOCS)
    got = {(r.doc_id, r.size, r.source_size, r.taken) for r in mixing.mix(odd).collect()}
    assert {g[:3] for g in got} == {(1, 0, 0), (2, 0, 0), (3, 2, 6), (None, 2, 6)} and sum(g[3] for g in got if g[0] in (1, 2)) == 0
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixture(odd.where("doc_id<3")).count() == 0


def brute(vectors, queries, k):
    out = []
    for q in queries:
        scored = sorted((-int(np.dot(vectors[q], vectors[c])), c) for c in vectors if c != q)[:k]
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    return out


@pytest.mark.parametrize("block, queries", [(4_096, 1_024), (37, 5)])
def test_top_k_equals_brute_force_with_ties_and_skewed_lengths(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 8)) * rng.lognormal(sigma=1.5, size=(300, 1))
    data[50:90] = data[50]
    data[120:140] = 0
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(data)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = {i: np.floor(64 * v).astype(np.int64) for i, v in enumerate(data)}
    got = topk.search(table, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(vectors, range(0, 300, 20), 20)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (6, [1.0]), (None, [9.0]), (7, [-1.0, 0.5]), (0, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(table, F.col("vec_id") == 0, k=20).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 6, 4_096), (0, 2, 6, 4_096), (0, 3, 7, 0)]
    assert topk.search(table, F.col("vec_id") == 99).count() == 0 and topk.search(table.limit(0), F.col("vec_id") == 0).count() == 0
    huge = spark.createDataFrame([(0, [2.0**22, 3.0]), (1, [2.0**24, -5.0]), (2, [2.0**24, -6.0])], "vec_id long, embedding array<double>")
    got = topk.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2**58 - 192 * 320), (0, 2, 2, 2**58 - 192 * 384)]
