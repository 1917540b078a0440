from pyspark.sql import functions as F

from paperloom.functions import once
from paperloom.sources.invoices import invoices


def test_invoices_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(once, "PART_ROWS", 100)
    day = F.to_timestamp(F.lit("1998-02-03"))
    orders = spark.range(2000, numPartitions=1).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), day.alias("o_orderdate"), F.lit(5.0).alias("o_totalprice"))
    customer = spark.range(7).select(F.col("id").alias("c_custkey"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("c_name"))
    for most in ("-1", "10MB"):  # a shuffled join, and a broadcast one
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            parts = [r.n for r in invoices(orders, customer).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert sum(parts) == 2000 and max(parts) <= 110
