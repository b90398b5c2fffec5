from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from linkharbor.operators import eager, scale

OUT = "record_id long, sourceurl string, docordataseturl string, wasdocumentordatasetaccessible string, filesize string, n int, key_value string"
IN, EARLY = "url string, n int", "key_kind string, key_value string"


def data(spark):
    rows = [(k, "hot" if k % 3 else f"s{k}", "http://d" if k % 2 else "unreachable", "true" if k % 4 else "false", str(k + 1), 0, "clash") for k in range(300)]
    rows += [(900, None, "null", None, None, None, None), (901, "null", None, "true", "x", None, None), (901, "null", None, "true", "x", None, None)]
    return spark.createDataFrame(rows, OUT), spark.createDataFrame([("hot", 1)] * 7 + [(None, 2), ("s0", 3)], IN), spark.createDataFrame([("url", "http://d"), ("hash", "http://d"), (None, None)], EARLY)


def test_totals_equal_the_joined_rows(spark):
    o, i, e = data(spark)
    got = {(r.field_name, r.key_value): r for r in eager.totals(o, i, e).collect()}
    rows = o.collect()
    n = Counter(r.sourceurl for r in rows if r.sourceurl not in (None, "null"))
    assert {k[1]: r.n for k, r in got.items() if k[0] == "sourceurl"} == dict(n)
    joined = o.join(i, o.sourceurl == i.url).groupBy("sourceurl").agg(F.count("*").alias("n"), F.sum(o.filesize.cast("long")).alias("s")).collect()
    for r in joined:
        assert (got["sourceurl", r.sourceurl].joined_n, got["sourceurl", r.sourceurl].joined_total_size) == (r.n, r.s)
    d = got["docordataseturl", "http://d"]
    assert (d.right_n, d.found_n) == (1, sum(r.docordataseturl == "http://d" and r.wasdocumentordatasetaccessible == "true" for r in rows))
    assert ("docordataseturl", "unreachable") in got and not any(k[1] in (None, "null") for k in got)


def test_hot_and_empty(spark):
    o, i, e = data(spark)
    assert {(r.field_name, r.key_value) for r in eager.hot(o, i, e).collect()} == {("sourceurl", "hot"), ("docordataseturl", "http://d"), ("docordataseturl", "unreachable")}
    assert eager.hot(o.limit(0), i, e).count() == 0 and eager.totals(o.limit(0), i.limit(0), e.limit(0)).count() == 0


def test_right_values(spark):
    l = eager.compact(spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int"), ["k"], sums={"v": F.col("v")})
    r = eager.compact(spark.createDataFrame([("a", 10), ("a", 20), ("a", None)], "k string, w int"), ["k"], sums={"w": F.col("w")})
    row = eager.eager_join(l, r, ["k"], ["v"], ["w"]).collect()
    assert [(x.k, x.joined_n, x.joined_v, x.joined_w) for x in row] == [("a", 6, 9, 60)]
    up = eager.roll_up(eager.eager_join(l, r, ["k"], ["v"], ["w"], "left"), [], ["joined_n", "v"]).collect()[0]
    assert (up.joined_n, up.v) == (6, 8)


def test_running_counts_match_a_plain_window(spark):
    from pyspark.sql import Window

    rows = [(k, None if k % 11 == 0 else "hot" if k % 3 else f"d{k % 5}", k % 2) for k in range(500)]
    df = spark.createDataFrame(rows, "seq long, domain string, x int").repartition(7)
    want = df.withColumn("s", F.sum("x").over(Window.partitionBy("domain").orderBy("seq"))).select("seq", "s")
    got = scale.running(df, ["domain"], "seq", {"s": F.col("x")}, blocks=13).select("seq", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r.nth for r in scale.ranked(df, "seq").orderBy("seq").collect()] == list(range(1, 501))
    assert scale.ranked(df.limit(0), "seq").count() == 0


def test_lookup_keeps_rows_and_nulls(spark):
    left = spark.createDataFrame([(k, None if k == 0 else "hot" if k < 3000 else f"k{k}") for k in range(3100)], "seq long, key string")
    right = spark.createDataFrame([("hot", 1), ("k3001", 2), (None, 3)], "key string, v int")
    got = scale.lookup(left, right, ["key"]).collect()
    assert len(got) == 3100 and Counter(r.v for r in got) == {1: 2999, None: 100, 2: 1}
    assert scale.lookup(left, right, ["key"], "inner").count() == 3000
