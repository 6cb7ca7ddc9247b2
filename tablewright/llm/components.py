"""Connected components of a link table, on the cluster throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.storage import drop, written


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every end of ``links(a, b)``: rows (id, root).

    Rounds of large-star and small-star, each of which keeps the links' components and shortens their paths, until
    every link leads straight to its root. The least neighbour is a map-side combined aggregate written to the shared
    folder before the join back, so that a hub's links are split over tasks. Null ends and self-links are ignored;
    an empty table gives an empty result. ``max_rounds`` guards against a defect only: paths shorten by half or more
    in each round.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
        large = (
            both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        after = written(small, "links")
        drop(edges, nearest, large, least)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
