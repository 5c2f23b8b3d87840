"""Chunked scans against plain windows, on one hot group and many small ones."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelake.operators import ordered
from framelake.operators.ordered import Scan, dense_index, hot_join, ordered_scan

def scans():
    return [
        Scan("position", "position"), Scan("before", "sum_before", F.col("v")), Scan("upto", "sum_upto", F.col("v")),
        Scan("max_before", "max_before", F.col("v")), Scan("max_upto", "max_upto", F.col("v")),
        Scan("prev", "prev", F.col("n")), Scan("next", "next", F.col("n")), Scan("last_before", "last_before", F.col("n")),
        Scan("first_after", "first_after", F.col("n")), Scan("total", "total", F.col("v")), Scan("highest", "highest", F.col("v")),
        Scan("lowest", "lowest", F.col("v")), Scan("first", "first", F.col("n")), Scan("last", "last", F.col("n")),
    ]


def plain(df):
    w = W.partitionBy("k").orderBy("o")
    before, whole = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = W.partitionBy("k").orderBy("o").rowsBetween(1, W.unboundedFollowing)
    zero = F.lit(0)
    return df.select(
        "*", (F.row_number().over(w) - 1).alias("position"), F.coalesce(F.sum("v").over(before), zero).alias("before"),
        F.sum("v").over(w).alias("upto"), F.max("v").over(before).alias("max_before"), F.max("v").over(w).alias("max_upto"),
        F.lag("n").over(w).alias("prev"), F.lead("n").over(w).alias("next"),
        F.last("n", True).over(before).alias("last_before"), F.first("n", True).over(after).alias("first_after"),
        F.sum("v").over(whole).alias("total"), F.max("v").over(whole).alias("highest"), F.min("v").over(whole).alias("lowest"),
        F.first("n", True).over(whole).alias("first"), F.last("n", True).over(whole).alias("last"),
    )


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


def test_hot_group_across_many_chunks(spark):
    base = spark.range(0, 2000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 7 + 1).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v")
    )
    df = base.withColumn("n", F.when(F.col("v") > 7, F.col("v")))
    same(ordered_scan(df, ["k"], ["o"], scans(), width=32), plain(df))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40, unique_by=lambda t: t[:2]))
def test_scan_equals_window_on_any_rows(spark, data):
    df = spark.createDataFrame([(k, o, o * 3 % 5, n) for k, o, n in data], "k long, o long, v long, n long")
    same(ordered_scan(df, ["k"], ["o"], scans(), width=4), plain(df))


def test_dense_index(spark):
    df = spark.createDataFrame([(1, 50), (1, 7), (2, 9), (1, 4000)], "k long, o long")
    assert {(r.k, r.o): r.idx for r in dense_index(df, ["k"], "o", width=16).collect()} == {(1, 7): 0, (1, 50): 1, (1, 4000): 2, (2, 9): 0}


def test_hot_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 10)
    monkeypatch.setattr(ordered, "HOT_SPLITS", 4)
    left = spark.range(0, 300).select(F.when(F.col("id") < 100, None).when(F.col("id") < 250, 1).otherwise(F.col("id") % 5 + 2).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "bb"), (9, "z")], "k int, name string")
    for how in ("left", "inner", "left_semi"):
        got = hot_join(left, right, ["k"], ["id"], how)
        want = left.join(right, "k", how)
        same(got, want)
