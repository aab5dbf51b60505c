"""Connected components of links between ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# A task's share: the steps below are many, and a few links need not be dealt over many tasks.
LINKS_AT_ONCE = 50_000


def _stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, which cuts its lineage."""
    path = scratch_path(df.sparkSession, "links")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (x, y): the smallest id reachable.

    Alternates two steps until nothing changes. Large: each id's larger neighbours link to
    its smallest neighbour. Small: its smaller neighbours do. The links never become
    more, and no row holds more than two ids, so a hub is only a frequent key.
    """
    links = _stored(
        links.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    )
    before, tasks = None, links.count() // LINKS_AT_ONCE + 1
    while True:
        both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low")).coalesce(tasks)
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y")).coalesce(tasks)
        large = large.distinct().coalesce(tasks)
        low = large.groupBy("x").agg(F.min("y").alias("low")).coalesce(tasks)
        small = (
            large.join(low, "x").select(F.col("y").alias("x"), F.col("low").alias("y"))
            .unionByName(low.select("x", F.col("low").alias("y"))).where("x <> y").coalesce(tasks).distinct()
        )
        links = _stored(small.coalesce(tasks))
        # Each round's links as one number; the same links again mean that all is settled.
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    own = links.select(F.col("x").alias("id"), F.col("y").alias("component"))
    roots = links.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
    return own.unionByName(roots)


def components_after(label: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that gave ``label`` and more ``links``: only what these join is gone through again."""
    of = label.select(F.col("id").alias("x"), F.col("component").alias("p")), label.select(F.col("id").alias("y"), F.col("component").alias("q"))
    between = links.select("x", "y").join(of[0], "x", "left").join(of[1], "y", "left")
    joined = _stored(components(between.select(F.coalesce("p", "x").alias("x"), F.coalesce("q", "y").alias("y"))))
    # Both ends of a link inside a component go by that component's name, which ``label`` has.
    moved = label.join(joined.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left")
    new = joined.join(label.select("id"), "id", "left_anti")
    return _stored(moved.select("id", F.coalesce("now", "component").alias("component")).unionByName(new))
