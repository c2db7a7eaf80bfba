from pyspark.sql import functions as F

from staylens.plans import registry, text_queries
from staylens.sources.bindings import orders_warehouse

registry.load()
SF = "/root/testdata/sf0.001"


def test_many_options_are_dealt_to_more_tasks(spark, monkeypatch):
    """The windows over items sort what a task gets: that follows the number of options, not Spark's number of partitions alone."""
    whole = {tuple(r) for r in registry.QUERIES["exact_duplicate_options"](spark, SF).collect()}
    monkeypatch.setattr(text_queries, "PER_TASK", 500, raising=False)
    out = registry.QUERIES["exact_duplicate_options"](spark, SF)
    assert {tuple(r) for r in out.collect()} == whole
    assert out.groupBy(F.spark_partition_id()).count().count() >= 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_dealt_observations_are_the_same(spark):
    some, dealt = orders_warehouse(spark, SF).observations, orders_warehouse(spark, SF, 500).observations
    assert some.columns == dealt.columns and some.exceptAll(dealt).isEmpty() and dealt.exceptAll(some).isEmpty()
