"""Block-wise running operators and skew-proof joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import dedupe, ordered
from tidewarden.operators.skew import attach


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(5)
    rows, pos = [], 0
    for _ in range(400):
        pos += rnd.choice([1, 1, 1, 7, 40])
        rows.append((rnd.choice(["a", "a", "a", "b", None]), pos, rnd.choice([None, rnd.randint(0, 99)])))
    return rows


@pytest.fixture()
def frame(spark, log):
    return spark.createDataFrame(log, "k string, pos bigint, v int").repartition(5)


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_running_max_and_index(frame, log, block):
    got = {r.pos: (r.m, r.i) for r in ordered.row_index(
        ordered.running_max_before(frame, ["k"], "pos", F.col("v"), "m", block), ["k"], "pos", "i", block).collect()}
    seen = {}
    for k, pos, v in log:
        best, n = seen.get(k, (None, 0))
        assert got[pos] == (best, n + 1)
        seen[k] = (v if best is None else best if v is None else max(best, v), n + 1)
    assert len(got) == len(log)


@pytest.mark.parametrize("block,n", [(3, 10), (50, 25), (1 << 20, 7), (10, 10_000)])
def test_newest(frame, log, block, n):
    got = sorted((r.k or "", r.pos) for r in ordered.newest(frame, ["k"], "pos", n, block).collect())
    want = []
    for key in {r[0] for r in log}:
        want += [(key or "", p) for k, p, _ in log if k == key][-n:]
    assert got == sorted(want)


@pytest.mark.parametrize("hot_keys,hot_min", [(1, 1), (1000, 1), (2, 50), (5, 10**9)])
def test_attach_is_the_same_for_hot_and_cold_keys(frame, log, hot_keys, hot_min):
    per_key = frame.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    got = sorted((r.pos, r.n, r.s) for r in attach(
        frame, per_key, ["k"], "n", hot_keys=hot_keys, hot_min_rows=hot_min).collect())
    count, total = {}, {}
    for k, _, v in log:
        count[k] = count.get(k, 0) + 1
        total[k] = total.get(k, 0) + (v or 0)
    assert got == sorted((p, count[k], total[k]) for k, p, _ in log)


def test_attach_keeps_rows_without_partner(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id int, k string")
    right = spark.createDataFrame([("x", 1, 10)], "k string, n bigint, s int")
    for weight in ("n", None):
        out = attach(left, right, ["k"], weight, hot_min_rows=1)
        assert sorted((r.id, r.s) for r in out.collect()) == [(1, 10), (2, None)]


@pytest.mark.parametrize("hot_min", [1, 10**9])
def test_flag_duplicates_with_a_hot_id(spark, hot_min):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", f"id{rnd.randint(0, 80)}", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "offset bigint, event_id string").repartition(7)
    got = {r.offset: r.is_duplicate for r in dedupe.flag_duplicates(
        df, "event_id", ["offset"], hot_min_rows=hot_min).collect()}
    seen = set()
    for i, e in rows:
        assert got[i] == (e is not None and e in seen)
        seen.add(e)
    kept = sorted(r.offset for r in dedupe.keep_first(df, "event_id", ["offset"]).collect())
    assert kept == sorted(i for i, d in got.items() if not d)


def test_hot_id_is_not_shuffled_by_id(spark):
    """The hot id reaches its rows by broadcast, and its rows are salted."""
    df = spark.range(20_000).selectExpr("id AS offset", "IF(id % 3 = 0, 'hot', concat('e', id)) AS event_id")
    flagged = dedupe.flag_duplicates(df, "event_id", ["offset"], hot_min_rows=1000)
    assert flagged.where("is_duplicate").count() == 20_000 // 3
    plan = flagged._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "_salt" in plan


def test_not_landed(spark):
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "event_id string")
    old = spark.createDataFrame([("a",)], "event_id string")
    assert [r.event_id for r in dedupe.not_landed(new, old).collect()] == ["b", "b"]


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_running_sums(frame, log, block):
    got = {r.pos: (r.s, r.p) for r in ordered.running_sums(frame.withColumn("one", F.lit(1)), ["k"], "pos", {"s": "v", "p": "one"}, block).collect()}
    seen = {}
    for k, pos, v in log:
        s, n = seen.get(k, (0, 0))
        seen[k] = (s + (v or 0), n + 1)
        assert (got[pos][0] or 0, got[pos][1]) == seen[k]
    assert len(got) == len(log)


@pytest.mark.parametrize("block", [1, 10, 10_000])
def test_asof_join(spark, block):
    rnd = random.Random(4)
    left = [(rnd.choice(["a", "a", "b", None]), rnd.choice([None, *range(0, 400, 3)]), i) for i in range(300)]
    right = [(rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(0, 400, 9)]), rnd.choice([None, 1, 2, 3])) for i in range(80)]
    lf = spark.createDataFrame(left, "k string, at bigint, id int").repartition(4)
    rf = spark.createDataFrame(right, "k string, at bigint, v int").repartition(3)
    got = {r.id: r.v for r in ordered.asof(lf, rf, ["k"], "at", ["v"], block).collect()}
    assert len(got) == len(left)
    for k, at, i in left:
        known = [(t, -1 if v is None else v) for g, t, v in right if g == k and t is not None and at is not None and t <= at]
        want = max(known)[1] if known else None
        assert got[i] == (None if want == -1 else want)
