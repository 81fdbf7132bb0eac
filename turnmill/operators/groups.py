"""Groups that links reach, as written rounds of aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import working_folder


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the least node that links reach. In a round every node takes the
    least neighbour of its neighbourhood as its own (large star, then small star), which halves chains; a round combines before its
    shuffles, so a node with many links does not have them in one task. Each round is a table in the shared folder."""
    spark = links.sparkSession
    at, k, seen = working_folder(spark, "groups"), 0, None
    star = lambda x: F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias(x)

    def written(df: DataFrame) -> DataFrame:
        nonlocal k
        k += 1
        df.write.parquet(f"{at}/{k}")
        return spark.read.schema(df.schema).parquet(f"{at}/{k}")

    now = written(links.where("a <> b").select("a", "b").distinct())
    while True:
        both = now.select(star("x")).select("x.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        now = written(small.where("a <> b").distinct())
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = sums
