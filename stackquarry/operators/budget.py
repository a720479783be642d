"""Admission against a daily budget: ST02 in batch form.

Requests of a (user, day) are taken in order. One is admitted when what has been
spent plus its estimate stays within the limit; only then its actual cost is
added. That is a fold, so a group has to be walked in order, but it never has to
sit in one task:

* ``ordered_chunks`` cuts the ordered rows into chunks of bounded size;
* a fold over one (user, day, chunk) needs only the spend at its start;
* a group inside one chunk starts with nothing spent. For the few groups that
  cross a chunk border (fewer than there are chunks) the start is found from chunk
  summaries. Spend never falls, so requests whose estimate exceeds what is left are
  refused for good; when all the others of a chunk fit together they add their sum,
  whatever their order: that is so if the sum and the greatest estimate fit the least
  of their limits. Only a chunk between these cases is folded, alone, and the
  summaries of the chunks after it are taken again with what is then left.

So a hot group whose budget is used up, or far from it, is settled by aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackquarry.operators.ordered import join_same, ordered_chunks

GROUP = ["user_id", "day"]
ORDER = ["ts", "req_id"]
NEEDED = [*GROUP, *ORDER, "est_micro", "cost_micro", "limit_micro"]


def budget_gate(
    requests: DataFrame, chunks: int | None = None, opening: DataFrame | None = None
) -> DataFrame:
    """requests: user_id, day, ts, req_id, est_micro, cost_micro, limit_micro.

    Adds admitted, spent_before_micro (the spend the request was tested against)
    and the refusal message. (ts, req_id) is unique within a user and day, costs
    are not negative. ``opening`` (user_id, day, spent_micro) is what has been spent
    before the first of these requests; groups without a row start at 0.
    """
    rows = requests.select(*NEEDED)
    if opening is None:
        rows = rows.withColumn("opening", F.lit(0).cast("bigint"))
    else:
        spent = opening.select(*GROUP, F.col("spent_micro").alias("opening"))
        rows = join_same(rows, spent, GROUP, "left").withColumn(
            "opening", F.coalesce("opening", F.lit(0).cast("bigint"))
        )
    pieces = ordered_chunks(rows, GROUP, ORDER, chunks)
    decided = fold_slices(pieces, starting_spend(pieces))
    return decided.withColumn("error", refusal_message())


def refusal_message():
    remaining = (F.col("limit_micro") - F.col("spent_before_micro")) / 1e6
    text = F.format_string(
        "daily budget exceeded. Remaining: $%.2f, Estimated cost: $%.2f",
        remaining,
        F.col("est_micro") / 1e6,
    )
    return F.when(~F.col("admitted"), text)


def border_groups(pieces: DataFrame) -> dict[tuple, list[int]]:
    """The groups that cross a chunk border, each with its chunks in order.

    Only the first and last group of a chunk can cross, so this collects one row
    per chunk however many rows there are.
    """
    edges = (
        pieces.groupBy("chunk")
        .agg(F.min(F.struct(*GROUP)).alias("first"), F.max(F.struct(*GROUP)).alias("last"))
        .collect()
    )
    edges.sort(key=lambda e: e["chunk"])
    crossing: dict[tuple, list[int]] = {}
    for before, after in zip(edges, edges[1:]):
        if before["last"] == after["first"]:
            chunks = crossing.setdefault(tuple(after["first"]), [before["chunk"]])
            chunks.append(after["chunk"])
    return crossing


def slice_summaries(
    pieces: DataFrame, waiting: dict[tuple, list[int]], spent: dict[tuple, int]
) -> dict[tuple, dict]:
    """One row per waiting slice (user_id, day, chunk): limit, opening, the least
    estimate, and the summed cost and greatest estimate of the requests that still
    fit what is left of the budget now. Spend never falls, so the others are refused
    whatever comes first. Fewer than two rows per chunk are collected."""
    keys = [(*group, min(chunks), spent.get(group)) for group, chunks in waiting.items()]
    schema = T.StructType(
        [
            *(pieces.schema[c] for c in GROUP),
            T.StructField("from_chunk", T.IntegerType()),
            T.StructField("spent", T.LongType()),
        ]
    )
    open_chunks = sorted({c for chunks in waiting.values() for c in chunks})
    rows = (
        join_same(
            pieces.filter(F.col("chunk").isin(open_chunks)),
            F.broadcast(pieces.sparkSession.createDataFrame(keys, schema)),
            GROUP,
        )
        .filter(F.col("chunk") >= F.col("from_chunk"))
    )
    fits = F.col("est_micro") <= F.col("limit_micro") - F.coalesce("spent", "opening")
    found = rows.groupBy(*GROUP, "chunk").agg(
        F.max("limit_micro").alias("limit"),
        F.min(F.when(fits, F.col("limit_micro"))).alias("tightest"),
        F.max("opening").alias("opening"),
        F.min("est_micro").alias("least"),
        F.max(F.when(fits, F.col("est_micro"))).alias("most"),
        F.sum(F.when(fits, F.col("cost_micro"))).alias("total"),
    )
    return {(*(r[k] for k in GROUP), r["chunk"]): r.asDict() for r in found.collect()}


def starting_spend(pieces: DataFrame) -> list[tuple]:
    """(user_id, day, chunk, spend) at the start of every slice of a crossing group."""
    waiting = border_groups(pieces)
    spent: dict[tuple, int] = {}
    starts: list[tuple] = []
    while waiting:
        summaries = slice_summaries(pieces, waiting, spent)
        unclear = []
        for group, chunks in list(waiting.items()):
            spent.setdefault(group, summaries[*group, chunks[0]]["opening"])
            while chunks:
                chunk = chunks.pop(0)
                start, piece = spent[group], summaries[*group, chunk]
                starts.append((*group, chunk, start))
                if piece["total"] is None:
                    continue
                if start + piece["total"] + piece["most"] <= piece["tightest"]:
                    spent[group] = start + piece["total"]
                    continue
                if chunks:
                    unclear.append((*group, chunk, start))
                break
            if not chunks:
                del waiting[group]
        if unclear:
            spent.update(_spend_after(pieces, unclear))
    return starts


def _spend_after(pieces: DataFrame, slices: list[tuple]) -> dict[tuple, int]:
    """Fold just these slices. A file holds one chunk, so the chunk filter skips the
    other files by their statistics."""
    wanted = _starts_frame(pieces, slices)
    own = join_same(
        pieces.filter(F.col("chunk").isin([s[2] for s in slices])),
        F.broadcast(wanted.drop("start")),
        [*GROUP, "chunk"],
        "left_semi",
    )
    ends = fold_slices(own, slices).groupBy(*GROUP).agg(
        F.max(F.col("spent_before_micro") + F.when(F.col("admitted"), F.col("cost_micro")).otherwise(0)).alias("end")
    )
    return {tuple(r[k] for k in GROUP): r["end"] for r in ends.collect()}


def _starts_frame(pieces: DataFrame, starts: list[tuple]) -> DataFrame:
    schema = T.StructType(
        [*(pieces.schema[c] for c in [*GROUP, "chunk"]), T.StructField("start", T.LongType())]
    )
    return pieces.sparkSession.createDataFrame(starts, schema)


def group_text() -> list:
    """User and day as text: in pandas a NULL among numbers would turn them to floats."""
    return [F.col("user_id").cast("string").alias("user_text"), F.col("day").cast("string").alias("day_text")]


def group_back(pieces: DataFrame) -> list:
    return [
        F.col("user_text").cast(pieces.schema["user_id"].dataType).alias("user_id"),
        F.col("day_text").cast("date").alias("day"),
    ]


def fold_slices(pieces: DataFrame, starts: list[tuple]) -> DataFrame:
    """Decide every row of ``pieces``; a slice is one (user, day, chunk)."""
    rows = pieces
    if starts:
        # at most two rows per chunk, see border_groups
        rows = join_same(rows, F.broadcast(_starts_frame(pieces, starts)), [*GROUP, "chunk"], "left")
    else:
        rows = rows.withColumn("start", F.lit(None).cast("bigint"))
    slice_key = [*GROUP, "chunk"]
    ordered = (
        rows.repartition(*slice_key)
        .sortWithinPartitions(*slice_key, *ORDER)
        .select(
            *group_text(),
            "chunk",
            "req_id",
            "est_micro",
            "cost_micro",
            "limit_micro",
            F.coalesce("start", "opening").alias("start"),
        )
    )
    kept = ["user_text", "day_text", "req_id", "est_micro", "cost_micro", "limit_micro"]
    schema = T.StructType(
        [ordered.schema[c] for c in kept]
        + [
            T.StructField("admitted", T.BooleanType()),
            T.StructField("spent_before_micro", T.LongType()),
        ]
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, spent = None, 0
        for batch in batches:
            admitted, before = [], []
            for user, day, chunk, est, cost, limit, start in zip(
                *(batch[c].tolist() for c in ("user_text", "day_text", "chunk", "est_micro", "cost_micro", "limit_micro", "start"))
            ):
                if (user, day, chunk) != current:
                    current, spent = (user, day, chunk), start
                fits = spent + est <= limit
                admitted.append(fits)
                before.append(spent)
                if fits:
                    spent += cost
            out = batch[kept].copy()
            out["admitted"] = admitted
            out["spent_before_micro"] = before
            yield out

    return ordered.mapInPandas(fold, schema).select(
        *group_back(pieces),
        *kept[2:],
        "admitted",
        "spent_before_micro",
    )
