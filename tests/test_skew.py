from pyspark.sql import functions as F

from leafmill.operators.skew import hot_keys, salted_join


def test_hot_keys_are_exact_and_few(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 300, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    assert [(r.k, r._n) for r in hot_keys(rows, ["k"], 100).collect()] == [("hot", 300)]
    assert hot_keys(rows, ["k"], 300).count() == 0
    assert hot_keys(rows.limit(0), ["k"], 1).count() == 0


def test_salted_join_is_a_join(spark):
    facts = spark.range(600).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"), "id")
    unique = spark.createDataFrame([("hot", 1), ("4", 2), ("none", 3)], "k string, v int")
    want = {(r.id, r.k, r.v) for r in facts.join(unique, "k", "left").collect()}
    for threshold in (10, 10**6):
        got = salted_join(facts, unique, ["k"], F.col("id"), threshold, salts=4).collect()
        assert len(got) == 600 and {(r.id, r.k, r.v) for r in got} == want
