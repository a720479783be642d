"""Work that depends on the order of rows inside a group, without gathering a group.

``ordered_chunks`` sorts the rows over the cluster by (group, order) with a range
exchange and names each range partition a chunk. The sort key is unique, so a
chunk has about rows / chunks rows however skewed the groups are: a group that
holds a third of all rows simply spans a third of the chunks, in order. The
result is written once; chunk numbers are then plain data and stay the same when
a lost task is run again. Each written file holds one chunk, so a filter on chunk
skips the others by their row-group statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackquarry.sources.checkpoints import dropped, written

#: Rows of a chunk at most, about: what one task walks through in order.
ROWS_PER_CHUNK = 1_000_000


def chunk_count(stored: DataFrame) -> int:
    """At least the session's shuffle partitions, more for a table of many rows."""
    partitions = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, stored.count() // ROWS_PER_CHUNK + 1)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL equals NULL: requests without a user are a group too."""
    renamed = right.withColumnsRenamed({key: f"_same_{key}" for key in keys})
    same = reduce(lambda a, b: a & b, [left[key].eqNullSafe(renamed[f"_same_{key}"]) for key in keys])
    return left.join(renamed, same, how).drop(*[f"_same_{key}" for key in keys])


def ordered_chunks(
    df: DataFrame, group: list[str], order: list[str], chunks: int | None = None
) -> DataFrame:
    """``df`` plus ``chunk``; chunks follow (group, order), which must be unique."""
    # Stored first: the range exchange reads its input twice.
    stored = written(df, "ordered_input")
    ranged = stored.repartitionByRange(chunks or chunk_count(stored), *group, *order)
    pieces = written(ranged.withColumn("chunk", F.spark_partition_id()), "ordered_chunks")
    dropped(stored)
    return pieces


def running_total(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    out: str,
    chunks: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` per group, this row included."""
    return running_totals(df, group, order, {out: value}, chunks)


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    values: dict[str, str],
    chunks: int | None = None,
) -> DataFrame:
    """Running sums per group, this row included, as new columns named by the keys.

    Running sums inside each (group, chunk), plus what earlier chunks of the group
    add up to. The second part works on one row per (group, chunk).
    """
    pieces = ordered_chunks(df, group, order, chunks)
    local = (
        Window.partitionBy(*group, "chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = pieces.groupBy(*group, "chunk").agg(*[F.sum(v).alias(f"_sum_{out}") for out, v in values.items()])
    carried = (
        sums.withColumns({f"_carried_{out}": F.sum(f"_sum_{out}").over(earlier) for out in values})
        .filter(F.coalesce(*[f"_carried_{out}" for out in values]).isNotNull())
        .drop(*[f"_sum_{out}" for out in values])
    )
    running = pieces.withColumns({out: F.sum(v).over(local) for out, v in values.items()})
    return (
        join_same(running, carried, [*group, "chunk"], "left")
        .withColumns({out: F.col(out) + F.coalesce(f"_carried_{out}", F.lit(0)) for out in values})
        .drop("chunk", *[f"_carried_{out}" for out in values])
    )


def running_best(df: DataFrame, group: list[str], order: list[str], values: dict[str, str], chunks: int | None = None) -> DataFrame:
    """The greatest value so far per group, this row included, as new columns named by the
    keys; NULL where there is none yet. Chunks as in ``running_totals``."""
    pieces = ordered_chunks(df, group, order, chunks)
    local = Window.partitionBy(*group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.groupBy(*group, "chunk")
        .agg(*[F.max(value).alias(f"_most_{out}") for out, value in values.items()])
        .withColumns({f"_carried_{out}": F.max(f"_most_{out}").over(earlier) for out in values})
        .drop(*[f"_most_{out}" for out in values])
    )
    running = pieces.withColumns({out: F.max(value).over(local) for out, value in values.items()})
    return (
        join_same(running, carried, [*group, "chunk"], "left")
        .withColumns({out: F.greatest(out, f"_carried_{out}") for out in values})
        .drop("chunk", *[f"_carried_{out}" for out in values])
    )
