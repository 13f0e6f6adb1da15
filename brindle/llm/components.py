"""Connected components of a link table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.dealing import fetched, hot_keys, hot_of
from brindle.llm.session import cut, drop


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (id long, component long), the smallest id of the component; one row per linked id.

    Each round points every id at its smallest neighbour, replaces the ends of the links by
    what they point at and drops closed links, so a star is done in one round and a chain in
    a number of rounds that grows as the logarithm of its length.  A hub's links are dealt to
    several tasks.  The result is a written table, which the caller may drop.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"), "k"))
        # no more rows of links hold an id, and no more ids point at it, than it has neighbours (and itself)
        hot = hot_keys(near.select("id", "k"))
        # an id that points at one which points further down takes the further one
        up = near.select(F.col("id").alias("to"), F.col("to").alias("top"))
        least = cut(fetched(near.select("id", "to"), up, ["to"], hot).select("id", F.col("top").alias("to")))
        old = [links, label, near]
        if label is None:
            label = least.withColumnRenamed("to", "component")
            label.written = least.written
        else:
            step = least.select(F.col("id").alias("component"), "to")
            (many,) = hot_of(label, ["component"])
            label = cut(fetched(label, step, ["component"], many, "left").select("id", F.coalesce("to", "component").alias("component")))
            old.append(least)
        ends = fetched(links, least.select(F.col("id").alias("a"), F.col("to").alias("x")), ["a"], hot)
        ends = fetched(ends, least.select(F.col("id").alias("b"), F.col("to").alias("y")), ["b"], hot)
        links = cut(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        for table in old:
            drop(table)
    if label is None:
        label = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
        label.written = links.written
    return label
