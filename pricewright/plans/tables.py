"""The synthetic tables re-hosted as price data: parts are products, line items are offers of suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def products(self) -> DataFrame:
        """(product, retail, cost) in whole cents."""
        retail = F.round(F.col("p_retailprice") * 100).cast("bigint")
        return self.part.select(F.col("p_partkey").alias("product"), retail.alias("retail"), F.floor(retail * 80 / 100).alias("cost"))

    @property
    def offers(self) -> DataFrame:
        """(product, source, cents, ord, line, shipped): an offer lies at 85 to 124 % of the retail price."""
        p = self.products.select("product", "retail")
        share = 85 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 40
        cents = F.expr("retail * share DIV 100")
        li = self.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
        return li.join(p, li.l_partkey == p["product"]).withColumn("share", share).select("product", F.col("l_suppkey").alias("source"), cents.alias("cents"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"))

    @property
    def regional(self) -> DataFrame:
        """Offers with the nation and the region of their source."""
        s = self.supplier.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("nation"))
        n = self.nation.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
        return self.offers.join(s, "source").join(F.broadcast(n), "nation")  # 25 nations


#: The same in SQL.
CTE = {
    "products": "products AS (SELECT p_partkey AS product, CAST(round(p_retailprice * 100) AS BIGINT) AS retail, CAST(round(p_retailprice * 100) AS BIGINT) * 80 // 100 AS cost FROM part)",
    "offers": "offers AS (SELECT product, l_suppkey AS source, retail * (85 + (l_orderkey * 7 + l_linenumber * 13) % 40) // 100 AS cents, l_orderkey AS ord, l_linenumber AS line, l_shipdate AS shipped FROM lineitem JOIN products ON l_partkey = product)",
    "regional": "regional AS (SELECT o.*, s_nationkey AS nation, n_regionkey AS region FROM offers o JOIN supplier ON source = s_suppkey JOIN nation ON s_nationkey = n_nationkey)",
}


def sql(*names: str) -> str:
    return "WITH " + ", ".join(CTE[n] for n in names) + " "
