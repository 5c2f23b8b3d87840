"""Hard negatives, the quadratic classifier and collocations against plain Python, with edge cases."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import collocations, negatives, qda, queries
from framelake.llm import text as T

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, id string"
LABELLED = "doc_id long, text string, lang string, id string"


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 70), (100, 65, 131), (64, 64, 64), (7, 200, 3)])
@pytest.mark.parametrize("top", [5, 2**26, 2**40])
def test_strassen_is_the_exact_product(shape, top):
    rng = np.random.default_rng(sum(shape))
    a, b = rng.integers(-top, top, shape[:2]), rng.integers(-top, top, shape[1:])
    want = a.astype(object) @ b.astype(object)
    if max(abs(int(x)) for x in want.ravel()) >= 2**63:
        want = np.vectorize(lambda x: (int(x) + 2**63) % 2**64 - 2**63)(want)  # 64-bit integers wrap around
    assert (negatives.strassen(a, b, leaf=4) == want.astype(np.int64)).all()
    assert (negatives.strassen(a, b) == want.astype(np.int64)).all()


def test_heaps_merge_to_the_first_of_all():
    rng = np.random.default_rng(2)
    scores, numbers = rng.integers(0, 6, (9, 60)), rng.permutation(1000)[:60]
    fits, heap = rng.random((9, 60)) < 0.5, negatives.Heaps(4)
    for part in np.array_split(np.arange(60), 7):
        heap.add(np.arange(9), scores[:, part], fits[:, part], numbers[part])
    want = [(i, s, n) for i in range(9) for s, n in sorted(((int(s), int(n)) for s, n, f in zip(scores[i], numbers, fits[i]) if f), key=lambda x: (-x[0], x[1]))[:4]]
    assert list(zip(heap.owner.tolist(), heap.score.tolist(), heap.number.tolist())) == want


def plain_negatives(rows, asks, scale=256, k=5):
    fine = [(i, [int(np.floor(scale * float(x))) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, lab in sorted({(i, tuple(v), lab) for i, v, lab in fine if asks(i)}):
        score = lambda w: sum(a * b for a, b in zip(v, w))
        own = sorted(((-score(w), j) for j, w, m in fine if m == lab and j != i))[:k]
        other = sorted((-score(w), j) for j, w, m in fine if m != lab)
        for p, j in own:
            window = [(s, n) for s, n in other if 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("block, anchors, tile", [(8192, 1024, (256, 2048)), (17, 5, (4, 7))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, anchors, tile):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("TILE", tile)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(block)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4], int(rng.choice([1, 1, 2, 3])), "x") for i in rng.integers(0, 150, 180)]
    rows += [(100, [0.5] * 6, 1, "x"), (100, [0.5] * 6, 1, "y"), (100, [0.25] * 6, 1, "x"), (0, [], 2, "x"), (4, [0.5] * 3, 1, "z")]  # ties and repeats
    rows += [(None, [1.0], 1, "x"), (8, None, 1, "x"), (9, [1.0], None, "x"), (10, [None, 1.0], 1, "x"), (12, [float("nan")], 1, "x"), (20, [float("inf")], 2, "x")]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0)
    assert got.schema.simpleString() == "struct<" + ",".join(c.replace(" ", ":").replace("long", "bigint") for c in negatives.RESULT.split(", ")) + ">"
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives([r[:3] for r in rows], lambda i: i % 10 == 0)
    assert negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, [1e30], 1, "x")], VECTORS), F.col("vec_id") == 0)


def test_quality_on_held_out_documents(spark):
    got = queries.op12_quality_classifier(spark, SF)
    rows = got.join(T.table(spark, SF, "labels"), "doc_id").collect()
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == T.documents(spark, SF).count()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.96
    assert all(r.predicted == 0 for r in held if r.quality == 0)


def test_quadratic_discriminant_equals_plain_densities(spark):
    docs, labels = T.documents(spark, SF), T.table(spark, SF, "labels")
    rows = qda.condensed(docs, ["doc_id"])
    model = qda.fit(rows, labels)
    mark = {r.doc_id: r.quality for r in labels.collect()}
    kept = [(np.array(r.x), mark[r.doc_id]) for r in rows.collect() if r.doc_id in mark]
    x, y = np.array([k[0] for k in kept]), np.array([k[1] for k in kept])
    x = np.clip((x - model.middle) / model.scale, -qda.REACH, qda.REACH)
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(c * (y == i).sum() for i, c in enumerate(cov)) / len(y)
    z = np.full(len(x), np.log((y == 1).sum() / (y == 0).sum()))
    for c, sign in ((0, -1), (1, 1)):
        own = qda.shrunk(cov[c], int((y == c).sum()), pooled)
        gap = x - x[y == c].mean(axis=0)
        z += sign * -0.5 * (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(own), gap) + np.linalg.slogdet(own)[1])
    want = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    assert np.allclose(model.score(np.array([k[0] for k in kept])), want, atol=1e-6)
    eye = qda.shrunk(np.diag([1.0, 2.0, 3.0]), 5, np.eye(3))
    assert np.linalg.eigvalsh(eye).min() > 0 and np.allclose(eye, eye.T)


def test_quality_edges(spark):
    odd = [(1, None, None, "a"), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "x" * 300_000, "en", "a"), (4, "x" * 300_000, "en", "a"), (None, "one two", "en", "a"), (5, "漢字 \U0001f600", "en", "a")]
    docs = spark.createDataFrame(odd, LABELLED).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = qda.classify(docs, none, F.lit(True), ["doc_id", "id"]).collect()
    assert len(got) == len(odd) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (9, 0)], "doc_id long, quality int")
    assert {r.score > 0.99 for r in qda.classify(docs, one, F.lit(True)).collect()} == {True}
    both = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (4, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in qda.classify(docs, both, F.lit(True)).collect())
    assert qda.classify(docs.limit(0), both, F.lit(True)).count() == 0


def plain_collocations(rows, longest, least, top, subsumed=100):
    n, f = Counter(), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(m == lang and len(q) > len(p) and 100 * b >= subsumed * a and inside(q) for (m, q), b in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((" ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted((lang, r + 1, *x) for lang, found in out.items() for r, x in enumerate(sorted(found, key=lambda x: (-x[5], -x[1], x[0].encode()))[:top]))


@pytest.mark.parametrize("least, subsumed, top, small", [(3, 100, 2000, False), (2, 60, 7, True)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, subsumed, top, small):
    if small:
        for name, value in (("TOKENS", 50), ("CHUNK", 20), ("ONE_STEP", 2), ("BITS", 1 << 10), ("SPREAD", 2)):
            monkeypatch.setattr(collocations, name, value)
    rng = np.random.default_rng(least)
    words = ["the", "Of", "é", "a-b", "\U0001f600x", "ÄB", "to", "in", "漢", "z"]
    weights = np.array([8, 6, 3, 2, 1, 1, 4, 3, 1, 1]) / 30
    texts = ["".join(str(w) + str(rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "], p=[0.6, 0.1, 0.05, 0.05, 0.1, 0.05, 0.05])) for w in rng.choice(words, int(rng.integers(0, 60)), p=weights)) for _ in range(120)]
    rows = [(i, t, [None, "en", "de", "l g\t1\n"][i % 4], "x") for i, t in enumerate(texts)]
    rows += [(1, None, "en", "x"), (2, "", None, "x"), (3, " \t.,\n", "xx", "x"), (4, "same same same same same", "und", "x"), (4, "same same same same same", "und", "x"), (5, "w " * 70_000, "hot", "x")]
    docs = spark.createDataFrame(rows, LABELLED).withColumns({"phrase": F.lit(1), "n": F.lit("z")}).repartition(3)
    got = collocations.mine(docs, least=least, subsumed=subsumed, top=top, segment_bytes=20_000 if small else 1 << 25)
    assert dict(got.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", **{c: "bigint" for c in ("a", "l", "r", "n", "score")}}
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations([(r[2], r[1]) for r in rows], 5, least, top, subsumed)
    assert collocations.mine(docs.limit(0)).count() == 0


def test_collocation_scores_do_not_pass_through_64_bits(spark):
    rows = spark.sql("select 'en' as lang, repeat('q w. ', 3000) as text from range(40)").unionAll(spark.sql("select 'en', repeat('u ', 900000) from range(2)"))
    got = collocations.mine(rows).where("phrase = 'q w'").first()
    assert (got.a, got.l, got.r, got.n) == (120_000, 120_000, 120_000, 2_040_000) and got.score == 1000 * got.n // got.a


def test_two_phrases_with_one_hash_are_told_apart():
    ids = np.array([1, 2, 3, 2, 1, 0, 1, 2, 0])
    at = np.array([0, 1, 2, 3, 6])
    for same in (np.zeros(5, dtype=np.uint64), np.array([1, 2, 3, 4, 1], dtype=np.uint64)):
        name, heads = collocations._named(same, at, ids, 2)
        want = [tuple(ids[a : a + 2]) for a in at]
        assert [tuple(ids[h : h + 2]) for h in heads[name]] == want and len(heads) == len(set(want))


def test_stripes_add_up_to_their_prefix(spark):
    docs = T.documents(spark, SF).select("lang", "text").limit(200)
    sums, phrases = collocations.frequent(docs.where("lang is not null"), least=20)
    total = {(r.lang, r.prefix): r.total for r in sums.where("width > 0").collect()}
    a = {(r.lang, r.phrase): r.a for r in phrases.where("width < 5").collect()}
    assert a and all(total[k] == v for k, v in a.items())
    largest = {(r.lang, r.prefix): r.largest for r in sums.collect()}
    for lang, p in itertools.islice(a, 0, None):
        if " " in p:
            assert largest[lang, p.rsplit(" ", 1)[0]] >= a[lang, p]
