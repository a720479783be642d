"""Project state kept between runs: S04, S05."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackquarry.wording import NO_SNAPSHOT

#: Projects share this many folders of a scan day.
BUCKETS = 64
END_OF_TIME = datetime(9999, 1, 1)
PLACE = ["scan_day", "bucket"]


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "scan_day": F.to_date("scan_ts"),
            "bucket": F.pmod(F.xxhash64("project"), F.lit(BUCKETS)).cast("int"),
        }
    )


def save_snapshot(resources: DataFrame, path: str, scans: DataFrame | None = None) -> None:
    """Append rows (with ``project`` and ``scan_ts``) to the snapshot table.

    The rows go to ``path/rows``, by scan day and a bucket of the project, sorted by
    project so that file statistics skip the others; the exchange before it cuts large
    folders by their size, so a project with a third of the rows is not written by one
    task. After that the scans are listed in the small table ``path/scans``; a scan
    counts from then on. ``scans`` (project, scan_ts) lists those that found no
    resource too: they hide the project's earlier ones.
    """
    placed = _placed(resources).hint("rebalance", *PLACE)
    placed.sortWithinPartitions(*PLACE, "project", "scan_ts").write.mode("append").partitionBy(*PLACE).parquet(
        f"{path}/rows"
    )
    listed = resources.select("project", "scan_ts")
    if scans is not None:
        listed = listed.unionByName(scans.select("project", "scan_ts"))
    listed.distinct().write.mode("append").parquet(f"{path}/scans")


def latest(snapshots: DataFrame) -> DataFrame:
    """The rows of each project's newest scan.

    The newest scan time is a plain aggregate (partial max per task), joined back;
    no project is gathered in one place.
    """
    newest = snapshots.groupBy("project").agg(F.max("scan_ts").alias("scan_ts"))
    return snapshots.join(newest, ["project", "scan_ts"], "left_semi")


def load_snapshot(spark: SparkSession, path: str, as_of: datetime = END_OF_TIME) -> DataFrame:
    """Each project's newest scan not after ``as_of``.

    The newest scans come from the list of scans, so a newest one without resources
    gives no row. While the list is small enough to be broadcast, the join prunes the
    folders of other days and buckets before reading them; beyond it the rows are
    joined by place, project and scan.
    """
    scans = spark.read.schema("project STRING, scan_ts TIMESTAMP").parquet(f"{path}/scans")
    newest = (
        scans.filter(F.col("scan_ts") <= F.lit(as_of))
        .groupBy("project")
        .agg(F.max("scan_ts").alias("scan_ts"))
    )
    rows = spark.read.parquet(f"{path}/rows")
    return rows.join(_placed(newest), [*PLACE, "project", "scan_ts"], "left_semi").drop(*PLACE)


def missing_snapshots(projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """An error row for each project that has no saved scan."""
    return (
        projects.select("project")
        .join(snapshots.select("project").distinct(), "project", "left_anti")
        .withColumn("error", F.lit(NO_SNAPSHOT))
    )
