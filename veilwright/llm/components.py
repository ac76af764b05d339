"""Connected components of a graph that is only ever held as a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.sources.scratch import Rounds, written


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; root is the smallest node of its component.

    `links` has columns a < b. Large-star and small-star steps in turn hang each node under the smallest node of its
    neighbourhood, until nothing changes: then all that is left are stars around the roots. Each round is written to
    the shared scratch folder, so that a lost executor costs at most one round; the driver sees two numbers of it.
    """
    with Rounds(links.sparkSession, "components") as rounds:
        edges = rounds.written(links.select("a", "b"))
        state, before = _state(edges), None
        while state[0] and state != before:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            # Stored: so this is a join of two plain shuffles, and Spark can split the many links of a root.
            least = rounds.written(both.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("least")))
            large = both.where("b > a").join(least, "a").select(F.col("least").alias("a"), "b")
            large = rounds.written(large)
            lowest = rounds.written(large.groupBy("b").agg(F.min("a").alias("least")))
            small = large.join(lowest, "b").select(F.col("least").alias("a"), F.col("a").alias("b")).where("a < b")
            edges = rounds.written(small.unionByName(lowest.select(F.col("least").alias("a"), "b")).distinct())
            state, before = _state(edges), state
        return written(edges.select(F.col("b").alias("node"), F.col("a").alias("root")), "components")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0
