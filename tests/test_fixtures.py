"""Data facts of the fixture views at sf0.01 (FIXTURES.md)."""

from pyspark.sql import functions as F

from tesserae.sources import fixtures as fx

from .conftest import SF_CHECK


def test_fixture_sizes(spark):
    assert fx.people(spark, SF_CHECK).count() == 15000
    assert fx.user_metrics(spark, SF_CHECK).count() == 15000
    assert fx.users(spark, SF_CHECK).count() == 1500
    assert fx.nodes(spark, SF_CHECK).count() == 2000
    assert fx.kv_nodes(spark, SF_CHECK).count() == 25
    assert fx.pairs(spark, SF_CHECK).count() == 44445
    assert fx.raw_pairs(spark, SF_CHECK).count() == 60000  # one per line item: linear


def test_fixture_facts(spark):
    u = fx.users(spark, SF_CHECK)
    assert u.filter(F.col("active") & (F.col("login_count") > 500)).count() == 566
    jobs = {r[0] for r in u.select("profile.job").distinct().collect()}
    assert jobs == {"AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"}
    assert fx.user_metrics(spark, SF_CHECK).filter(F.col("session_duration") >= 120).count() == 14523
    assert fx.user_metrics(spark, SF_CHECK).select("user_id").distinct().count() == 15000
    tags = u.select(F.size("tags").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert (tags[0], tags[1]) == (2, 5)
