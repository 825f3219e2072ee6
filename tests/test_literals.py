from pyspark.sql import functions as F

from frostline.functions import text as T


def test_a_literal_is_looked_at_once(spark):
    """An expression that names its parts again and again grows with each; this one took 27 patterns for an element."""
    rows = spark.range(1).select(F.lit("a=1,b=[1, 'x', 2.5],c=(3)").alias("t"))
    plan = rows.select(T.kwargs(F.col("t")).alias("k"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") + plan.count("RLIKE") < 30


def test_literals_of_all_kinds(spark):
    texts = [" 7 ", "-2", "1e3", ".5", "True", "None", "x", "'a b'", "[1, 'b', None]", "(1,)", "(5)", "('q')", "[]", "()", "(1, 2]", "[a]", "[[1]]", "(True, 2.5)", "", None, "99999999999999999999"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(T.literal(F.col("t")).alias("l")).collect()
    kinds = [r.l.kind for r in found]
    assert kinds == ["int", "int", "float", "float", "bool", "none", "str", "str", "list", "tuple", "int", "str", "list", "tuple", "str", "str", "str", "tuple", "str", "str", "float"]
    assert [found[i].l.int for i in (0, 1, 10)] == [7, -2, 5] and found[7].l.str == "a b" and found[11].l.str == "q"
    assert [(i.kind, i.int, i.str) for i in found[8].l["items"]] == [("int", 1, None), ("str", None, "b"), ("none", None, None)]
    assert found[0].l["items"] is None and found[12].l["items"] == []
