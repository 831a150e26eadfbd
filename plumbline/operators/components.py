"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.sources.staging import drop_staged_table, staged_path


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component.

    A large star ties the larger neighbours of each node to its smallest one, a small star the smaller ones;
    when a round changes nothing every component is a star. The links of a round are written, so a lost
    executor costs one round at most and plans stay short. No component is brought to one task.
    """
    spark = links.sparkSession

    def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = staged_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    edges, path = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("digest")).first()
        if state == before or not state.n:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        before = state
        turned = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        centre = turned.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("centre"))
        large, large_path = written(turned.where("b > a").join(centre, "a").select(F.col("centre").alias("a"), "b").where("a < b").distinct(), "large")
        below = large.groupBy("b").agg(F.min("a").alias("centre"))
        small = large.join(below, "b").select("centre", F.explode(F.array("a", "b")).alias("b")).select(F.col("centre").alias("a"), "b")
        edges, small_path = written(small.where("a < b").distinct(), "small")
        for old in (path, large_path):  # the new links are written, so nothing reads these any more
            drop_staged_table(spark, old)
        path = small_path
