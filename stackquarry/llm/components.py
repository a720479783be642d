"""Connected components of a link table by alternating stars.

Each round hangs every larger neighbour of a node on the node's smallest neighbour, then
every smaller one; the rounds end when the links stop changing, which is after a number
of rounds that grows with the logarithm of the nodes. A node's neighbours are never
gathered: only their minimum is, and links are joined with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackquarry.llm.shared import dropped, shared_table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b) after one star step."""
    if large:
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = links
    least = ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))
    moved = ways.join(least, ways["a"] == least["node"])
    if large:
        moved = moved.where(F.col("b") > F.col("a"))
    ends = moved.select(F.col("b"), F.col("least"))
    if not large:
        ends = ends.unionByName(least.select(F.col("node").alias("b"), "least"))
    return ends.where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node that has a link, from rows (a, b).
    Self-links are passed over."""
    ordered = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = shared_table(ordered.distinct(), "links")
    state = _fingerprint(current)
    while True:
        large = shared_table(_star(current, True), "stars")
        small = shared_table(_star(large, False), "stars")
        dropped(current, large)
        current, before, state = small, state, _fingerprint(small)
        if state == before:
            return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )


def _fingerprint(links: DataFrame) -> tuple:
    """Count and two sums over the links: equal when a round changed nothing."""
    row = links.agg(
        F.count("*"),
        F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
        F.sum(F.hash("b", "a").cast("bigint")),
    ).first()
    return tuple(row)
