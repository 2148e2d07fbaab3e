"""Every operator that spreads hot keys is compared with the plain form, with the hot path forced on."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from seamline.operators import ordered
from seamline.operators.intervals import interval_join
from seamline.operators.skew import hot_keys, in_chunks, skew_join


@pytest.fixture(scope="module")
def timeline(spark):
    """One key holds most rows, many of them inside one short stretch."""
    rng = random.Random(1)
    data = [("hot", i, 50 + rng.random(), rng.randint(0, 9)) for i in range(400)]
    data += [("hot", 400 + i, rng.random() * 1000, rng.randint(0, 9)) for i in range(100)]
    data += [(f"k{i % 20}", 500 + i, rng.random() * 1000, rng.randint(0, 9)) for i in range(150)]
    return spark.createDataFrame(data, "k string, id long, t double, v long").cache()


def test_hot_keys_and_their_fan(timeline):
    found = {r.k: r._fan for r in hot_keys(timeline, ["k"], 50).collect()}
    assert found == {"hot": 10}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_the_plain_join(spark, timeline, rows, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("none", 4)], "k string, w int")
    assert rows(skew_join(timeline, right, ["k"], how, min_rows=20)) == rows(timeline.join(right, ["k"], how))


def test_both_sides_hot(spark, timeline, rows):
    right = spark.createDataFrame([("hot", i) for i in range(30)] + [("k1", 50), ("none", 60)], "k string, w int")
    left = timeline.select("k", "id")
    got = skew_join(left, right, ["k"], spread=["id"], right_spread=["w"], min_rows=10)
    assert rows(got) == rows(left.join(right, ["k"]))


def test_hot_chunks_are_cut(timeline):
    placed = in_chunks(timeline, ["k"], "t", 100.0, True, 50)
    biggest = placed.groupBy("k", "_chunk", "_part").count().agg(F.max("count")).first()[0]
    assert biggest < 20
    assert placed.count() == timeline.count()
    back = placed.withColumn("o", F.lag(F.struct("_chunk", "_part")).over(W.partitionBy("k").orderBy("t")))
    assert back.filter(F.struct("_chunk", "_part") < F.col("o")).count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_running_totals_match_a_plain_window(timeline, rows, split):
    got = ordered.running_totals(
        timeline, ["k"], "t", {"s": F.col("v"), "n": F.lit(1).cast("long")}, {"all": "s"}, 100.0, split_hot=split, min_rows=50
    )
    w = W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("k")
    want = timeline.select("*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.sum("v").over(whole).alias("all"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("current", [True, False])
def test_carry_forward_matches_a_plain_window(timeline, rows, current):
    value = F.when(F.col("v") < 2, F.col("id"))
    got = ordered.carry_forward(timeline, ["k"], "t", value, "last", 100.0, current=current, split_hot=True, min_rows=50)
    w = W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, 0 if current else -1)
    assert rows(got) == rows(timeline.withColumn("last", F.last(value, True).over(w)))


def test_positions_cross_chunks(spark, rows):
    df = spark.createDataFrame([("a", i * 3) for i in range(40)] + [("b", 7)], "k string, seq long")
    got = ordered.numbered(df, ["k"], "seq", "rn", total="n", width=10)
    assert rows(got) == sorted([("a", i * 3, i + 1, 40) for i in range(40)] + [("b", 7, 1, 1)], key=repr)


def test_asof_join_matches_brute_force(spark, timeline):
    rng = random.Random(2)
    asked = [("hot", i, 50 + rng.random()) for i in range(200)] + [("hot", 200 + i, 60.0) for i in range(200)]
    asked += [(f"k{i % 25}", 400 + i, rng.random() * 1000) for i in range(100)]
    left = spark.createDataFrame(asked, "k string, q long, at double")
    got = ordered.asof_join(left, timeline, ["k"], "at", "t", ["id", "t"], "f", ties=F.col("id"), width=100.0, min_rows=50).collect()
    known = timeline.collect()
    assert len(got) == len(asked)
    for r in got:
        before = [(x.t, x.id) for x in known if x.k == r.k and x.t <= r.at]
        assert (r.f and r.f.id) == (max(before)[1] if before else None)


@pytest.mark.parametrize("closed", [False, True])
def test_interval_join_matches_a_theta_join(spark, timeline, rows, closed):
    spans = [("hot", 1, 0.0, 50.5), ("hot", 2, 50.25, 51.0), ("hot", 3, 10.0, 10.0), ("k1", 4, 0.0, 900.0), ("k2", 5, 30.0, 20.0)]
    spans += [("hot", r.id + 100, r.t, r.t + 0.01) for r in timeline.filter("k = 'hot'").limit(60).collect()]
    spans += [("hot", 1000 + i, 50.1, 50.2) for i in range(40)]
    right = spark.createDataFrame(spans, "k string, s long, a double, b double")
    got = interval_join(timeline, right, ["k"], "t", "a", "b", 25.0, closed=closed, spread=["id"], min_rows=30)
    upper = F.col("t") <= F.col("b") if closed else F.col("t") < F.col("b")
    want = timeline.join(right, "k").filter((F.col("a") <= F.col("t")) & upper)
    assert rows(got) == rows(want)


def test_rows_without_key_or_order_stay(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("a", 70_000), (None, 5), (None, None)], "k string, n long")
    got = ordered.numbered(df, ["k"], "n", "at").collect()
    assert sorted(((r.k or "", r.n or 0, r["at"]) for r in got)) == [("", 0, 1), ("", 5, 2), ("a", 0, 1), ("a", 1, 2), ("a", 70_000, 3)]
    carried = ordered.carry_forward(df, ["k"], "n", F.col("n"), "last", current=False).collect()
    assert sorted((r.k or "", r.n or 0, r["last"]) for r in carried if r["last"]) == [("a", 70_000, 1)] and len(carried) == 5


@pytest.mark.parametrize("closed", [False, True])
def test_long_and_open_spans(spark, rows, closed):
    inf, rng = float("inf"), random.Random(3)
    points = [("a", i, rng.choice([1, 1e3, 1e6, 1e9, 1e12]) * (rng.random() - 0.3)) for i in range(300)]
    points += [("a", 300, inf), ("a", 301, -inf), ("a", 302, float("nan")), ("a", 303, None), ("b", 304, 5.0), ("c", 305, 1e300), (None, 306, 1.0)]
    spans = [("a", 0, 0.0, 1e10), ("a", 1, -inf, inf), ("a", 2, 100.0, inf), ("a", 3, -inf, 0.0), ("b", 4, 5.0, 5.0), ("c", 5, -1e300, 1e301), ("a", 6, None, 9.0), ("a", 7, float("nan"), inf), (None, 8, 0.0, 9.0)]
    for i in range(60):
        at, length = rng.choice([1, 1e4, 1e8]) * (rng.random() - 0.5), rng.choice([0, 1, 50, 1e4, 1e7, 1e11])
        spans.append(("a", 10 + i, at, at + length))
    left, right = spark.createDataFrame(points, "k string, id long, t double"), spark.createDataFrame(spans, "k string, s long, a double, b double")
    got = interval_join(left, right, ["k"], "t", "a", "b", 10.0, closed=closed, spread=["id"])
    holds = lambda p, s: p[0] == s[0] is not None and None not in (p[2], s[2]) and (s[2] <= p[2] <= s[3] if closed else s[2] <= p[2] < s[3])
    assert sorted((r.id, r.s) for r in got.collect()) == sorted((p[1], s[1]) for p in points for s in spans if holds(p, s))
    # A span's rows don't depend on its length.
    few = interval_join(left.limit(1), spark.createDataFrame([("a", 1, 0.0, 1e15)], "k string, s long, a double, b double"), ["k"], "t", "a", "b", 1.0)
    assert few.count() <= 1


def test_positions_far_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_BITS", 3)
    df = spark.createDataFrame([("a", i * 1000, i % 5) for i in range(200)] + [("a", -5000, 1), ("b", 2**62, 2), ("b", -(2**62), 3)], "k string, seq long, v long")
    got = ordered.running_totals(df, ["k"], "seq", {"s": F.col("v")}, {"all": "s"}, width=10)
    w = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    assert rows(got) == rows(df.select("*", F.sum("v").over(w).alias("s"), F.sum("v").over(W.partitionBy("k")).alias("all")))
    value = F.when(F.col("v") == 1, F.col("seq"))
    for current in (True, False):
        last = ordered.carry_forward(df, ["k"], "seq", value, "last", width=10, current=current)
        w = W.partitionBy("k").orderBy("seq").rowsBetween(W.unboundedPreceding, 0 if current else -1)
        assert rows(last) == rows(df.withColumn("last", F.last(value, True).over(w)))


def test_no_window_holds_a_whole_key(spark):
    """Rows one to a chunk: the windows over their summaries go by blocks of chunks, and only blocks are taken by key."""
    df = spark.range(1000).selectExpr("'a' AS k", "id * 65536L * 16777216L AS seq")
    got = ordered.numbered(df, ["k"], "seq", "rn")
    assert got.agg(F.max("rn"), F.countDistinct("rn")).first()[:] == (1000, 1000)
    summaries = df.withColumns({"_chunk": F.expr("seq div 65536"), "_part": F.lit(0), "n": F.lit(1)})
    blocks = ordered.scanned_before(summaries, ["k"], {"n": "n"}, ordered._sum).groupBy("k", ordered.BLOCK).count()
    assert blocks.count() == 1000
