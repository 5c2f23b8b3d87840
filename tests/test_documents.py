import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from framelake.operators import compare, documents

TEXTS = [
    (1, json.dumps({"id": "a", "clips": [{"id": "x", "frames": []}, {"id": "y", "frames": [{"n": 1, "extra": {"deep": 2}}, 7]}]})),
    (2, json.dumps({"id": "b", "clips": [], "token": {"path": "/home/me/x"}, "note": ["C:\\work\\y", "/run/1/z", "plain"]})),
    (3, "[1, 2]"), (4, "{broken"), (5, None), (6, json.dumps({"id": None})),
]
SHAPES = ["id", "clips", "clips[].id", "clips[].frames", "clips[].frames[].n", "note"]


@pytest.fixture
def nodes(spark):
    return documents.walk(spark.createDataFrame(TEXTS, "doc long, text string"), ["doc"], "text")


def plain(value, place=""):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", type(None): "null"}[type(value)]
    yield place, kind
    if isinstance(value, dict):
        for k, v in value.items():
            yield from plain(v, f"{place}.{k}" if place else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain(v, f"{place}[{i}]")


def test_every_node_of_every_depth_is_a_row(nodes):
    want = [(d, *n) for d, t in TEXTS if d not in (4, 5) for n in plain(json.loads(t))] + [(4, "", "malformed"), (5, "", "malformed")]
    assert rows(nodes, "doc", "place", "kind") == sorted(want, key=repr)
    assert rows(nodes.where("doc = 1 and place = 'clips[1].frames[0].extra.deep'"), "shape", "parent", "name", "value") == [("clips[].frames[].extra.deep", "clips[].frames[].extra", "deep", "2")]


def test_nested_unknown_and_missing_keys(nodes):
    assert rows(documents.closed_schema(nodes, ["doc"], SHAPES)) == sorted([
        (1, "clips[1].frames[0].extra", "unknown"), (1, "note", "missing"), (2, "token", "unknown"),
        (3, "", "not-an-object"), (4, "", "not-an-object"), (5, "", "not-an-object"), (6, "clips", "missing"), (6, "note", "missing"),
    ], key=repr)


def test_nested_secrets_and_private_paths(nodes):
    assert rows(documents.private_content(nodes, ["doc"])) == sorted([
        (2, "token", "secret-key"), (2, "token.path", "private-path"), (2, "note[0]", "private-path"), (2, "note[1]", "private-path"),
    ], key=repr)
    hidden = documents.redacted(nodes, "/run/1").where("doc = 2 and parent = 'note'")
    assert [r.value for r in hidden.orderBy("place").collect()][1:] == ["z", "plain"]


def test_documents_are_compared_at_any_depth(spark, nodes):
    other = [(1, TEXTS[0][1].replace('"deep": 2', '"deep": 3').replace('"frames": []', '"frames": [0]')), *TEXTS[1:]]
    again = documents.walk(spark.createDataFrame(other, "doc long, text string"), ["doc"], "text")
    diff = compare.document_diff(documents.leaves(nodes, ["doc"]), documents.leaves(again, ["doc"]), ["doc"])
    assert rows(diff, "doc", "path", "state") == [(1, "clips[0].frames[0]", "unexpected"), (1, "clips[1].frames[0].extra.deep", "changed")]


def test_a_document_that_is_too_deep_is_refused(spark):
    deep = spark.range(1).select(F.col("id").alias("doc"), F.expr("concat(repeat('[', 6), repeat(']', 6))").alias("text"))
    assert documents.walk(deep, ["doc"], "text", 6).count() == 6
    with pytest.raises(ValueError):
        documents.walk(deep, ["doc"], "text", 4)


def test_texts_are_made_once_and_judged_without_a_shuffle(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(doc):
        made.add(1)
        return json.dumps({"id": doc, "clips": [{"id": "x", "frames": [{"n": [1, "[{\"]"]}]}]})

    docs = spark.range(20).select(F.col("id").alias("doc"), text(F.col("id")).alias("text"))
    found = documents.walk(docs, ["doc"], "text")
    unknown = documents.closed_schema(found, ["doc"], [*SHAPES, "name"])
    assert unknown.groupBy("place", "problem").count().orderBy("place").collect() == [("name", "missing", 20), ("note", "missing", 20)]
    assert found.count() == 20 * 10
    assert made.value == 20
    assert "Exchange" not in unknown._jdf.queryExecution().executedPlan().toString()
