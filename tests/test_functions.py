from pyspark.sql import functions as F

from lattica.functions.bounds import bounds_changed, is_completed, is_subtree_root, merge_lower, merge_upper, status_of


def test_merge_keeps_stricter_and_adds_missing(spark):
    df = spark.createDataFrame([({"x": 3.0, "y": 5.0}, {"x": 2.0, "z": 1.0})], "a map<string,double>, b map<string,double>")
    r = df.select(merge_upper("a", "b").alias("u"), merge_lower("a", "b").alias("l"),
                  bounds_changed("a", merge_upper("a", "b")).alias("c"),
                  bounds_changed("a", "a").alias("same")).first()
    assert r["u"] == {"x": 2.0, "y": 5.0, "z": 1.0}
    assert r["l"] == {"x": 3.0, "y": 5.0, "z": 1.0}
    assert r["c"] is True and r["same"] is False


def test_status_and_roots(spark):
    df = spark.createDataFrame([(True, True, 1, 0), (True, False, 3, 1), (False, False, 0, None)],
                               "f boolean, o boolean, d int, r int")
    r = df.select(status_of("f", "o").alias("s"), is_subtree_root("d", "r").alias("root"),
                  is_completed(status_of("f", "o")).alias("done")).collect()
    assert [x["s"] for x in r] == ["optimal", "feasible", "infeasible"]
    assert [x["root"] for x in r] == [False, False, True]
    assert [x["done"] for x in r] == [True, False, True]
