import hashlib
import random

from pyspark.sql import functions as F

from frostline.operators import batches

SCHEMA = "key string, tie long, place string, _key int, batch string"


def digest(*parts):
    return hashlib.md5("|".join(str(p) for p in (*parts, 42) if p is not None).encode()).hexdigest()


def order(row):
    key, tie = row[:2]
    return digest(key), key is not None, key or "", digest(tie), tie is not None, tie or 0


def test_places_are_those_of_one_sort(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "a", "a", *map(str, range(40))]), rng.choice([None, *range(500)]), "x", 1, "y") for _ in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(i, r[0], r[1], i // 64) for i, r in enumerate(sorted(rows, key=order))]
    for many in (1 << 16, 8):  # keys with many rows are ranked in parts
        found = batches.global_order(df, "key", ("tie",), many=many)
        assert sorted(found.columns) == sorted(df.columns)
        got = sorted((r.place, r.key, r.tie) for r in found.collect())
        assert got == [w[:3] for w in want]
    assert sorted((r.place, r.key, r.tie, int(r.batch)) for r in batches.in_batches(df, 64, "key", ("tie",)).collect()) == want


def test_rows_alike_take_their_places(spark):
    df = spark.createDataFrame([("a", 1)] * 300 + [("b", 1)] * 20, "key string, tie long")
    for many in (10, 1 << 16):
        assert sorted(r.place for r in batches.global_order(df, "key", ("tie",), many=many).collect()) == list(range(320))


def test_batches_collate(spark):
    df = spark.range(150).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    rows = {r.batch: r for r in batches.collated(batches.in_batches(df, 64, "key"), "key", "v").collect()}
    assert [rows[i].n for i in range(3)] == [64, 64, 22]
    assert [k for i in range(3) for k in rows[i].key] == sorted(range(150), key=lambda k: digest(k))
    assert all(r.v == [2 * k for k in r.key] for r in rows.values())


def test_no_sort_of_all_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    plan = batches.global_order(df, "key", ("key",))._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if "Window [" in line and "_bucket" not in line and "_start" not in line and "_at" not in line]
    assert not alone and "windowspecdefinition(_start" in plan


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert batches.in_batches(df, 8, "key", ("tie",)).count() == 0
