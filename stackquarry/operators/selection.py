"""The first k rows of each group, by distributed selection: A09, W03 for any k.

Values fall into bins with fixed, ordered borders: sign, binary order of magnitude and the
STEPS sub-steps of it. Counts per (group, bin) combine on the map side and say in which bin
the k-th row of each group lies. Only rows of that bin and of those above it go on: they are
range-sorted over the cluster and numbered, so neither a group with a third of all rows, nor
a large k, nor ties that fill a bin come to lie in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackquarry.operators.ordered import join_same, running_total

#: Bins of one binary order of magnitude.
STEPS = 64


def value_bin(value: Column) -> Column:
    """An INT that does not fall as a BIGINT or smaller integer rises; NULL first."""
    size = F.abs(value.cast("decimal(20,0)"))
    # bits of the value, and its share of the way from that power of two to the next
    order = F.when(size > 0, F.length(F.conv(size.cast("string"), 10, 2))).otherwise(F.lit(0))
    part = F.floor((size.cast("double") / F.pow(F.lit(2.0), order - 1) - 1) * STEPS)
    step = F.least(F.greatest(part, F.lit(0)), F.lit(STEPS - 1))
    place = F.when(order == 0, F.lit(0)).otherwise(order * STEPS + step).cast("int")
    return F.when(value < 0, -place).otherwise(place)


def top_rows(
    df: DataFrame, group: list[str], value: str, ties: list[str], k: str, out: str = "rank", chunks: int | None = None
) -> DataFrame:
    """Rows of ``df`` among the ``k`` largest by ``value`` of their group, ties by the columns
    ``ties`` ascending, with their place as BIGINT. ``k`` names a column that is the same all
    over a group; NULL values come last."""
    binned = df.withColumn("_bin", F.coalesce(value_bin(F.col(value)), F.lit(-(2**30))))
    counts = binned.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.max(k).alias("_k"))
    # one row per bin that the group has, at most 129 orders of magnitude of STEPS bins
    higher = Window.partitionBy(*group).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0))).filter(F.col("_above") < F.col("_k"))
    border = needed.groupBy(*group).agg(F.min("_bin").alias("_border"))
    chosen = join_same(binned, border, group).filter(F.col("_bin") >= F.col("_border")).drop("_bin", "_border")
    order = [F.desc_nulls_last(value), *ties]
    numbered = running_total(chosen.withColumn("_one", F.lit(1).cast("bigint")), group, order, "_one", out, chunks)
    return numbered.filter(F.col(out) <= F.col(k)).drop("_one")
