"""Look-ups with frequent, rare, absent and null keys."""

from rastrel.operators import lookup


def test_frequent_keys_meet_a_broadcast(spark):
    rows = spark.range(5_000).selectExpr("case when id % 10 < 4 then 7L when id % 10 = 4 then null else id end as k", "id as v")
    table = spark.range(0, 5_000, 3).selectExpr("id as k", "id * 2 as w").unionByName(spark.createDataFrame([(7, 1)], "k long, w long"))
    assert [r["k"] for r in lookup.frequent_keys(rows, ["k"], share=0.1, least=10).collect()] == [7]
    got = lookup.lookup(rows, table, ["k"], share=0.1, least=10)
    want = rows.join(table, ["k"], "left")
    assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, want.select("k", "v", "w").collect()))


def test_counts_can_be_given(spark):
    rows = spark.createDataFrame([(1, 1, "a")] * 30 + [(1, 2, "b")] * 2, "x long, y long, v string")
    counts = rows.groupBy("x", "y").count().withColumnRenamed("count", "n")
    table = spark.createDataFrame([(1, 1, 5)], "x long, y long, w long")
    got = lookup.lookup(rows, table, ["x", "y"], counts, share=0.5, least=5).collect()
    assert len(got) == 32 and {(r["v"], r["w"]) for r in got} == {("a", 5), ("b", None)}
