import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from frostline.operators import intervals

END = st.one_of(st.none(), st.integers(-40, 40), st.integers(-(10**6), 10**6), st.integers(-(2**61), 2**61))
ROW = st.tuples(st.sampled_from([1, 1, 1, 2, None]), END, END)
NEAR = st.tuples(st.just(1), st.integers(-20, 20), st.integers(1, 9)).map(lambda t: (t[0], t[1], t[1] + t[2]))
SCHEMA = "video_id long, start long, stop long, level int, left string"


def rows(spark, table):
    return spark.createDataFrame([(*t, i, "x") for i, t in enumerate(table)], SCHEMA)


def pairs(a, b, keyed):
    def meet(x, y):
        return None not in (*x, *y) and x[1] < x[2] and y[1] < y[2] and (not keyed or x[0] == y[0]) and max(x[1], y[1]) < min(x[2], y[2])

    return sorted((i, j, max(x[1], y[1]), min(x[2], y[2])) for i, x in enumerate(a) for j, y in enumerate(b) if (meet(x, y) if keyed else meet((0, *x[1:]), (0, *y[1:]))))


@given(st.lists(st.one_of(ROW, NEAR), max_size=25), st.lists(st.one_of(ROW, NEAR), max_size=25), st.booleans())
@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
def test_all_pairs_once(spark, a, b, keyed):
    found = intervals.overlap_join(rows(spark, a), rows(spark, b), ("video_id",) if keyed else ())
    assert sorted((r.left.level, r.right.level, r.start, r.stop) for r in found.collect()) == pairs(a, b, keyed)


def test_exact_powers_of_the_bins(spark):
    table = [(1, s, s + n) for s in (-64, -8, -1, 0, 1, 7, 8, 63, 64, 511) for n in (1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513)]
    found = intervals.overlap_join(rows(spark, table), rows(spark, table), ("video_id",))
    assert sorted((r.left.level, r.right.level, r.start, r.stop) for r in found.collect()) == pairs(table, table, True)


def test_a_long_range_lies_in_two_bins(spark):
    table = rows(spark, [(1, 5, 5 + 10**12), *((1, i, i + 1) for i in range(50))])
    ends = intervals._ranges(table, ("video_id",), "start", "stop", "left")
    home = intervals._in_bins(ends, intervals.F.array("_level"))
    assert home.count() <= 2 * 51 and home.where("left.level = 0").count() <= 2


def test_no_pair_of_tables_is_compared(spark):
    plan = intervals.overlap_join(rows(spark, [(1, 0, 5)]), rows(spark, [(1, 0, 5)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan) and re.search("HashJoin|SortMergeJoin", plan)


@pytest.mark.parametrize("empty", [(0, 1), (1, 0), (0, 0)])
def test_nothing(spark, empty):
    a, b = (rows(spark, [(1, 0, 5)] * n) for n in empty)
    assert intervals.overlap_join(a, b, ("video_id",)).count() == 0


def test_lags_that_nothing_touches(spark):
    lags = spark.createDataFrame([(1, 10, 5), (1, 30, 2), (2, 10, 5)], "video_id long, start long, length long")
    finds = spark.createDataFrame([(1, 8, 4), (1, 12, 9), (2, 15, 3)], "video_id long, start long, length long")
    found = {(r.video_id, r.start): (r.finds, r.covered) for r in intervals.lags_found(lags, finds).collect()}
    assert found == {(1, 10): (2, 5), (1, 30): (0, 0), (2, 10): (0, 0)}
