"""Consolidating pairwise matches into groups by hash-to-min.

The cluster set of every vertex is kept as rows (vertex, member), never as an array, so a
component of any size is spread over all tasks. Each round a vertex sends its set to its
smallest member and that smallest member to all others; the rounds end when every vertex but
the smallest of its component knows only that smallest one. Rounds grow with the logarithm of
the longest chain. The state is written to the shared folder each round, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from placeloom.session import discard, materialize


def hash_to_min(pairs: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """One row (id, group_id) for each id on either side of ``pairs``.

    ``group_id`` is the smallest id that is linked to ``id`` directly or through others.
    Null sides link nothing, and the other side then forms a group of its own unless further
    rows link it; a pair of equal ids likewise. Rows may repeat and stand in either order.
    No rows in, no rows out. Other columns are ignored, whatever their names.
    """
    spark = pairs.sparkSession
    sides = pairs.select(pairs[left].cast("long").alias("_a"), pairs[right].cast("long").alias("_b"))
    # a loop (a, a) carries ids without partner, so the vertex list needs no second scan
    both = sides.select(F.coalesce("_a", "_b").alias("_a"), F.coalesce("_b", "_a").alias("_b")).where("_a IS NOT NULL")
    links = both.select(F.explode(F.array(F.struct(F.col("_a").alias("v"), F.col("_b").alias("u")), F.struct(F.col("_b").alias("v"), F.col("_a").alias("u")), F.struct(F.col("_a").alias("v"), F.col("_a").alias("u")), F.struct(F.col("_b").alias("v"), F.col("_b").alias("u")))).alias("e"))
    state, path = materialize(links.select("e.v", "e.u").distinct(), "hash-to-min")
    if state.isEmpty():
        return state.select(F.col("v").alias("id"), F.col("u").alias("group_id"))
    for turn in range(max_rounds):
        least = state.groupBy("v").agg(F.min("u").alias("m"))
        # the set of a component's smallest vertex may be a third of all rows: adaptive plans split it over tasks
        sent = state.join(least, "v")
        # counted while the messages are made and written, so that each round is one evaluation
        watch = Observation(f"round {turn}")
        sent = sent.observe(watch, F.coalesce(F.sum(F.when((F.col("v") != F.col("m")) & (F.col("u") != F.col("m")), 1).otherwise(0)), F.lit(0)).alias("moved"))
        messages = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))
        # equal messages are dropped where they are made, before they are sent
        after, new_path = materialize(sent.select(F.explode(messages).alias("e")).select("e.v", "e.u").distinct(), "hash-to-min")
        if not watch.get["moved"]:
            discard(spark, new_path)
            return state.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("group_id"))
        discard(spark, path)
        state, path = after, new_path
    raise RuntimeError(f"not stable after {max_rounds} rounds")
