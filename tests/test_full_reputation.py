"""Reputation of all addresses: the hot ones too, and at most one row of an address, provider and second."""

from pyspark.sql import functions as F

from gatewarden.plans import queries
from gatewarden.sources import derived

SF = "/root/testdata/sf0.001"


def test_every_address_has_reputation(spark):
    t = queries.FullTables(spark, SF)
    asked = {r.ip for r in t.entries.select("ip").distinct().collect()}
    for provider in ("abuseipdb", "virustotal"):
        assert asked <= {r.ip for r in t.raw.where(F.col("provider") == provider).select("ip").distinct().collect()}
    hot = [r.ip for r in t.entries.groupBy("ip").count().orderBy(F.desc("count")).limit(4).collect()]
    assert t.geo.where(F.col("ip").isin(hot)).count() > 0 == queries.Tables(spark, SF).geo.where(F.col("ip").isin(hot)).count()
    assert t.raw.groupBy("ip", "provider", "query_sec").count().where("count > 1").count() == 0
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert derived.reputation_raw(spark, SF).count() * 10 < t.raw.count() <= events
