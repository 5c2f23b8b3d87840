"""Toxicity, quality and language identification: brute force, held-out accuracy, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import langid, quality, toxicity
from framelake.llm import text as T

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "x" * 200_000), (5, "12 34"), (5, "12 34"), (None, "one two"), (7, "漢字 \U0001f600")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_features_are_all_distinct_n_grams_of_the_whole_text(monkeypatch):
    text = "Abc ABC abd" * 50
    whole = set(toxicity.features(text).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert set(toxicity.features(text).tolist()) == whole
    assert len(toxicity.features(text)) == len(whole)
    assert toxicity.features("AB").tolist() == toxicity.features("ab").tolist()


def test_toxicity_on_held_out_documents(docs, labels):
    held = T.fold_of(modulus=5) == 0
    model = toxicity.fit(docs.where(~held), labels)
    got = toxicity.score(docs.where(held), model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_edges(spark, labels):
    empty = toxicity.fit(spark.createDataFrame([], DOCS), labels)
    rows = toxicity.score(spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("mine")), empty, ["doc_id", "score"]).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(1, "bad bad"), (2, "worse")], DOCS)
    marks = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.fit(one, marks).score("anything") > 0.99
    assert toxicity.score(spark.createDataFrame([], DOCS), empty).count() == 0


def plain_statistics(text):
    text = text or ""
    words = [w for w in __import__("re").split("[ \t\n\r\x0b\x0c]+", text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


@pytest.mark.parametrize("text", ["", None, "a b c a b c d", "x\nx\n\n \nx y", "one #*two |three| <x>", "a a a a a", "été été x", "a\x0bb\x1cc"])
def test_quality_counts_equal_the_plain_ones(text):
    assert quality.statistics(text)[0] == plain_statistics(text)


def test_quality_counts_on_documents(docs):
    for row in docs.limit(60).collect():
        assert quality.statistics(row.text)[0] == plain_statistics(row.text)


def test_trees_are_monotonic_and_flat_scoring_equals_walking():
    rng = np.random.default_rng(3)
    x = rng.random((2_000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(2_000)) > 0.7).astype(float)
    trees = quality.fit_trees(x, y, [1, 0, -1], trees=30)
    line = np.linspace(0, 1, 200)
    for at in rng.random((20, 3)):
        for feature, sign in ((0, 1), (2, -1)):
            points = np.tile(at, (200, 1))
            points[:, feature] = line
            assert (sign * np.diff(trees.score(points)) >= -1e-12).all()

    def walk(row):
        z = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] + (row[trees.feature[node]] > trees.threshold[node])
            z += trees.value[node]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])
    assert np.mean((trees.score(x) >= 0.5) == y) > 0.9


def test_quality_on_held_out_labels(docs, labels):
    held = F.col("doc_id") % 3 == 0
    trees = quality.fit(docs.where(~held), labels)
    got = quality.score(docs.where(held), trees).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in got]) > 0.95
    assert all(not (r.base_failed and r.kept) for r in got)


def test_quality_edges(spark, labels):
    trees = quality.fit(spark.createDataFrame([], DOCS), labels)
    rows = quality.score(spark.createDataFrame(ODD, DOCS), trees).collect()
    assert len(rows) == len(ODD) and all(r.base_failed and not r.kept for r in rows)
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], DOCS)
    assert quality.score(long, trees).first().kept


def test_language_on_held_out_documents(docs):
    held = T.fold_of(modulus=4) == 2
    model = langid.fit(docs.where(~held))
    got = langid.identify(docs.where(held), model, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert np.mean([r.rejected for r in got]) < 0.05
    junk = langid.identify(docs.sparkSession.createDataFrame([(1, "zqxj wvkq " * 40)], DOCS), model).first()
    assert junk.rejected


def test_language_scores_equal_the_plain_cosine(docs):
    model = langid.fit(docs)
    for row in docs.limit(10).collect():
        vector = np.log1p(langid.counts(row.text)) * model.idf
        cosine = (model.centroids @ vector) / np.linalg.norm(vector)
        name, score, _ = (x[0] for x in model.predict([row.text]))
        assert name == model.languages[model.owner[int(cosine.argmax())]] and abs(score - cosine.max()) < 1e-5


def test_language_edges(spark, monkeypatch):
    text = "Der Hund und die Katze laufen. " * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 11)
    assert (langid.counts(text) == whole).all()
    none = langid.fit(spark.createDataFrame([], DOCS + ", lang string"))
    rows = langid.identify(spark.createDataFrame(ODD, DOCS), none).collect()
    assert len(rows) == len(ODD) and {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    few = spark.createDataFrame([(1, "der die das", "de"), (2, "the and of", "en"), (3, None, "fr"), (4, "le la", None)], DOCS + ", lang string")
    model = langid.fit(few)
    assert model.languages == ["de", "en"]
    assert [langid.identify(spark.createDataFrame([(1, t)], DOCS), model).first().lang_pred for t in ("the of", "das", "123", None)] == ["en", "de", "und", "und"]
