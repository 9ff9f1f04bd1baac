"""Connected components of links, by Spark jobs over links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """`v, label` of every vertex with a smaller one in its component, the label being the smallest.

    `links` has rows (v, u), any comparable type without nulls.  A round points every vertex at the smallest vertex it is
    linked to, links the others of its links to that one, and then points it at where that one points; the length of a
    path halves, so rounds grow with the logarithm of the longest.  Only distinct links are kept, and written out between
    rounds.
    """
    larger = links.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).where(F.col("v") > F.col("u"))
    edges = cut(larger.distinct())
    while True:
        least = F.min("u").over(Window.partitionBy("v"))
        pointed = edges.withColumn("m", least)
        step = pointed.select("v", F.col("m").alias("u")).unionByName(
            pointed.where(F.col("u") > F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        step = cut(step)
        parents = cut(step.groupBy("v").agg(F.min("u").alias("p"))).withColumnRenamed("v", "x")
        # Both sides are plain frames, so a vertex that many point at is split by adaptive execution.
        moved = step.join(parents, F.col("u") == F.col("x"), "left").select(
            "v", F.coalesce("p", "u").alias("u"), F.col("p").isNotNull().alias("again"))
        moved = cut(moved)
        rest = moved.agg(F.max("again"), F.count("*"), F.count_distinct("v")).first()
        edges = cut(moved.select("v", "u").distinct())
        if not rest[0] and rest[1] == rest[2]:
            return edges.select("v", F.col("u").alias("label"))
