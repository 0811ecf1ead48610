"""Golden cases of the column functions and the metric log."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from emberline.functions import columns as C
from emberline.streaming.metric_log import appended, status_counts


@pytest.mark.parametrize(("budget", "best", "used"), [(1, 1.0, 1), (2, 0.5, 2), (3, 0.5, 3), (6, 0.2, 4)])
def test_truncated_best(spark, budget, best, used):
    rows = [("edit", "incorrect", None), ("edit", "ok", 0.5), ("edit", "ok", 0.49), ("edit", "ok", 0.2), ("stop", "stop", None), ("edit", "ok", 0.01)]
    df = spark.createDataFrame([(rows,)], "steps array<struct<kind:string,status:string,ratio:double>>")
    assert tuple(df.select(C.truncated_best(F.col("steps"), budget).alias("f")).first().f) == (best, used)


def test_best_of(spark):
    values = [1.0, 1.5, 2.0, 4.0, 7.0]
    df = spark.createDataFrame([(values[:n], k, n) for n in range(1, 6) for k in range(1, 7)], "v array<double>, k int, n int")
    for r in df.select("k", "n", C.expected_best_of(F.col("v"), F.col("k")).alias("e")).collect():
        if r.k > r.n:
            assert math.isnan(r.e)
        else:
            assert math.isclose(r.e, sum(max(c) for c in combinations(values[: r.n], r.k)) / math.comb(r.n, r.k))
    got = spark.createDataFrame([(4, 2, 0.5), (4, 1, 0.0)], "n int, c int, x double").select(C.p_reach(F.col("n"), F.col("c"), 1).alias("p"), C.p_reach(F.col("n"), F.col("c"), 2).alias("q"), C.p_reach(F.col("n"), F.col("c"), 5).alias("r")).collect()
    assert math.isclose(got[0].p, 0.5) and math.isclose(got[0].q, 1 - 1 / 6) and math.isclose(got[1].q, 0.5) and math.isnan(got[0].r)


@pytest.mark.parametrize(
    ("text", "kind", "code"),
    [("<EDIT>\nx = 1\n</EDIT>", "edit", "x = 1"), ("<EDIT>x", "edit", "x"), ("a<STOP>", "stop", None), ("<STOP><EDIT>x</EDIT>", "stop", None), ("<EDIT>x</EDIT><STOP>", "edit", "x"), ("<EDIT> \n</EDIT>", "malformed", None), ("hi", "malformed", None), ("", "malformed", None)],
)
def test_action(spark, text, kind, code):
    assert tuple(spark.createDataFrame([(text,)], "t string").select(C.action(F.col("t")).alias("a")).first().a) == (kind, code)


def test_hint_shares_reward(spark):
    df = spark.createDataFrame([("a</STATE>b</STATE>\n", "h", {"x": 1.0, "y": 3.0}, ["z", "x", "y"])], "o string, h string, m map<string,double>, n array<string>")
    r = df.select(C.with_hint(F.col("o"), F.col("h")).alias("o"), C.with_hint(F.lit("q"), F.col("h")).alias("p"), C.with_hint(F.lit("q"), F.lit("")).alias("e"), C.profile_shares(F.col("m")).alias("m"), C.hottest(F.col("m"), F.col("n")).alias("t"), C.hottest(F.col("m"), F.array(F.lit("z"), F.lit("w"))).alias("first")).first()
    assert (r.o, r.p, r.e, r.m, r.t, r.first) == ("a</STATE>bhint=h\n</STATE>\n", "q\nhint=h", "q", {"x": 0.25, "y": 0.75}, "y", "z")
    x = spark.range(1).select(C.reward(F.lit(0.5), F.lit(2), F.lit(1)).alias("a"), C.reward(F.lit(1e-30), F.lit(0), F.lit(0)).alias("b"), C.learning_rate(F.lit(0), 1.0, 0.1, 10, 100).alias("w"), C.learning_rate(F.lit(100), 1.0, 0.1, 10, 100).alias("l"), C.unit_hash(F.lit("a"), F.lit("b")).alias("u")).first()
    import hashlib

    assert math.isclose(x.a, math.log(2) - 0.07) and x.b == 4.0 and math.isclose(x.w, 0.1) and x.l == 0.1
    assert x.u == int(hashlib.sha1(b"a\n---\nb").hexdigest()[:16], 16) / 16**16


def test_metric_log(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("status")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, status string").parquet(str(tmp_path / "in"))
    query = appended(status_counts(stream, "1 day", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert query.exception() is None
    assert spark.read.schema("start string, status string, n long").json(str(tmp_path / "out")).agg(F.sum("n")).first()[0] > 0
