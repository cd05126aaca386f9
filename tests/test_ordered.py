import random

from pyspark.sql import functions as F

from cargohold.operators import ordered


def test_hot_key_and_nulls(spark):
    random.seed(3)
    rows = [("hot" if random.random() < 0.7 else random.choice(["a", None]), i, random.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r.i: (r.s, r.n, r.p) for r in ordered.previous(ordered.numbered(ordered.running_sum(df, ["k"], ["i"], F.col("v"), "s"), ["k"], ["i"], "n"), ["k"], ["i"], "v", "p").collect()}
    total, count, last = {}, {}, {}
    for k, i, v in rows:
        count[k] = count.get(k, 0) + 1
        assert got[i] == (total.get(k, 0), count[k], last.get(k))
        total[k], last[k] = total.get(k, 0) + (v or 0), v


def test_asof_both_ways(spark):
    left = spark.createDataFrame([(k, x) for k in ("a", "b") for x in [None, *range(0, 50, 3)]], "k string, x long")
    right = spark.createDataFrame([("a", y, f"m{y}") for y in (None, 5, 5, 20, 33)], "k string, y long, name string")
    for forward in (False, True):
        for r in ordered.asof(left, right, ["k"], "x", "y", ["name"], forward).collect():
            fit = [] if r.k == "b" or r.x is None else [y for y in (5, 20, 33) if (y >= r.x if forward else y <= r.x)]
            assert r.name == (f"m{min(fit) if forward else max(fit)}" if fit else None)


def test_ranges_of_all_lengths(spark):
    random.seed(4)
    ranges = [(random.choice("ab"), a, a + random.choice([0, 3, 70, 5_000, 10**6, 10**15, -1]), i) for i, a in enumerate(random.choices(range(-500, 500), k=60))] + [("a", None, 5, 98), ("a", 1, None, 99)]
    points = [(k, x) for k in "ab" for x in [None, *range(-520, 520, 13)]]
    found = ordered.in_ranges(spark.createDataFrame(points, "k string, x long"), spark.createDataFrame(ranges, "k string, a long, z long, i long"), "x", "a", "z", 4, ["k"])
    assert found.groupBy("i").count().count() > 20
    want = sorted((k, x, i) for k, x in points if x is not None for k2, a, z, i in ranges if k == k2 and a is not None and z is not None and a <= x <= z)
    assert sorted((r.k, r.x, r.i) for r in found.collect()) == want
    assert ordered.in_ranges(spark.createDataFrame(points, "k string, x long"), spark.createDataFrame([], "k string, a long, z long"), "x", "a", "z", 4, ["k"]).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "k string, i long, v long")
    assert ordered.running_sum(df, ["k"], ["i"], F.col("v"), "s").count() == 0
    assert ordered.asof(df, df.withColumnRenamed("i", "j"), ["k"], "i", "j", ["j"]).count() == 0
