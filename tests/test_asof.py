"""The as-of join against looking at every observation."""

import datetime
import random

import pytest

from tessera.operators.asof import as_of, as_of_each


@pytest.mark.parametrize("stretch", [1, 3600, 90 * 86400])
def test_latest_before(spark, stretch):
    rng = random.Random(stretch)
    start = datetime.datetime(2024, 1, 1)
    when = lambda: start + datetime.timedelta(seconds=rng.choice([rng.randrange(100), rng.randrange(20_000), rng.randrange(10**7)]))
    seen = {(rng.choice("aab"), rng.randrange(3), when()): (rng.choice([None, i]), str(i)) for i in range(300)}
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(3), rng.choice([when(), rng.choice([t for _, _, t in seen])])) for i in range(300)]
    asked += [(300, "a", 0, None), (301, "a", None, start), (302, "a", 1, start - datetime.timedelta(days=400))]
    left = spark.createDataFrame(asked, "id int, k string, n int, at timestamp").repartition(3)
    right = spark.createDataFrame([(k, n, t, x, y) for (k, n, t), (x, y) in seen.items()] + [(None, 0, start, 1, "z"), ("a", 0, None, 2, "z")], "k string, n int, seen timestamp, x int, y string")
    got = {r["id"]: (r["x"], r["y"]) for r in as_of(left, right, ["k", "n"], "at", "seen", ["x", "y"], stretch).collect()}
    for i, k, n, at in asked:
        before = [t for (a, b, t) in seen if a == k and b == n and at is not None and t <= at]
        assert got[i] == (seen[k, n, max(before)] if before else (None, None))
    assert as_of(left.limit(0), right, ["k", "n"], "at", "seen", ["x"]).count() == 0
    assert as_of(left, right.limit(0), ["k", "n"], "at", "seen", ["x"]).where("x is null").count() == len(asked)


def test_one_key_is_many_tasks(spark):
    """The rows of one key are dealt by stretches of time."""
    rows = spark.range(3000).selectExpr("'k' AS k", "id", "timestamp_seconds(id * 86400) AS at")
    found = as_of(rows, rows.selectExpr("k", "at AS seen", "id AS x"), ["k"], "at", "seen", ["x"], 30 * 86400)
    assert found.where("x = id").count() == 3000
    assert "_part" in found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning", 1)[1][:80]


@pytest.mark.parametrize("stretch", [3600, 90 * 86400])
def test_latest_of_each_kind(spark, stretch):
    """All kinds at once give what each gives alone, and an instant is sorted once."""
    rng = random.Random(stretch)
    rows = {(rng.choice("ab"), rng.choice(["x", "y", "z", None]), rng.randrange(50_000)): (rng.choice([None, i]), str(i)) for i in range(300)}
    asked = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(60_000)])) for i in range(200)]
    left = spark.createDataFrame(asked, "id int, k string, s long").selectExpr("id", "k", "timestamp_seconds(s) AS at")
    right = spark.createDataFrame([(*key, *v) for key, v in rows.items()], "k string, kind string, s long, v int, w string").selectExpr("k", "kind", "timestamp_seconds(s) AS seen", "v", "w")
    each = left.crossJoin(spark.createDataFrame([("x",), ("y",), ("q",)], "kind string"))
    want = as_of(each, right, ["k", "kind"], "at", "seen", ["v", "w"], stretch)
    got = as_of_each(left, right, ["k"], "kind", ["x", "y", "q"], "at", "seen", ["v", "w"], stretch)
    take = lambda df: sorted((tuple(r) for r in df.select("id", "kind", "v", "w").collect()), key=repr)
    assert take(got) == take(want) and sum(r[3] is not None for r in take(got)) > 100
