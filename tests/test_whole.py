"""Queries without SQL that must cover all rows."""

from pyspark.sql import functions as F

from alertloom.operators import decisions as de
from alertloom.operators.correlation import correlate
from alertloom.plans.catalog import QUERIES
from alertloom.plans.core_queries import ROLES
from alertloom.schema import alerts


def test_auto_correlation_covers_all_alerts(spark, small):
    users = {r.alert_idx: r.user_id for r in alerts(spark, small).select("alert_idx", "user_id").collect()}
    got = QUERIES["k1_auto_correlation"](spark, small).collect()
    assert len(got) == len(users) >= 1000
    assert all((r.correlation_method, r.pred_cluster) == ("scorer", users[r.alert_idx]) for r in got)


def test_auto_correlation_below_the_scorer(spark, small):
    scorer = lambda df: df.select("alert_idx", F.col("user_id").alias("cluster"))
    for n, way in ((60, "rules"), (150, "hybrid")):
        some = alerts(spark, small).where(F.col("alert_idx").isin(list(range(n)))).cache()
        got = de.correlate_auto(some, ROLES, 0.5, scorer).collect()
        assert len(got) == some.count() and {r.correlation_method for r in got} == {way}
        if way == "rules":
            want = {r.alert_idx: r.pred_cluster for r in correlate(some, ROLES, 0.5).collect()}
            assert {r.alert_idx: r.pred_cluster for r in got} == want
