import pytest

from frostline.plans import files, mechanisms, oracles, queries

from .compare import assert_same, connection

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | mechanisms.QUERIES | files.QUERIES, oracles.ORACLES | mechanisms.ORACLES | files.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), connection(SF).sql(ORACLES[name]).df())


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_matcher_moves_rows_once(spark):
    from frostline.operators.matcher import match_steps
    from frostline.sources.frames import event_scores

    events = spark.read.parquet(f"{SF}/events.parquet")
    plan = match_steps(event_scores(events))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_scan_reads_only_what_is_asked(spark):
    plan = QUERIES["motion_target_zscore"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan
