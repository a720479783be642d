"""Metadata, training pairs, results, chunk streams, memory dumps: S06-S12.

Writers take an optional Observation named by the caller; the row count becomes
available after the write without a second pass (A08).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stackquarry.functions.text import squeeze_ends
from stackquarry.schemas import CHUNK, METADATA, PAIR

KB_PER_GB = 1024 * 1024


def counted(df: DataFrame, observation: Observation | None) -> DataFrame:
    """Count rows while they are written; read ``observation.get["records"]`` after."""
    if observation is None:
        return df
    return df.observe(observation, F.count(F.lit(1)).alias("records"))


def write_metadata(
    df: DataFrame, path: str, batch: str, observation: Observation | None = None
) -> str:
    """Gzipped JSON lines under raw/<batch>; returns the folder."""
    target = f"{path}/raw/{batch}"
    counted(df, observation).write.option("compression", "gzip").json(target)
    return target


def write_metadata_arrays(df: DataFrame, path: str, batch: str, observation: Observation | None = None) -> str:
    """S06 in its other form: each gzipped file under raw/<batch> holds one top-level array,
    an object a line. A task streams its rows and holds back one."""
    target = f"{path}/raw/{batch}"

    def lines(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = "["
        comma = ""
        for table in tables:
            out = []
            for text in table.column(0).to_pylist():
                out.append(held)
                held, comma = comma + text, ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([held, "]"])], names=["value"])

    objects = counted(df, observation).select(F.to_json(F.struct(*df.columns)).alias("value"))
    objects.mapInArrow(lines, "value string").write.option("compression", "gzip").text(target)
    return target


def read_metadata(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Gzipped JSON. ``multi_line`` reads files that hold one top-level array;
    set it False for the line-per-object files of ``write_metadata``, which split."""
    return spark.read.schema(METADATA).option("multiLine", multi_line).json(path)


def write_pairs(
    df: DataFrame, path: str, batch: str, observation: Observation | None = None
) -> str:
    """One JSON object per line under train/<batch>; returns the folder."""
    target = f"{path}/train/{batch}"
    counted(df, observation).select("prompt", "completion").write.json(target)
    return target


def load_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A folder without pair files or with a bad line is an error; rows with an
    empty prompt or completion are dropped. Pair files are *.jsonl and the part files
    that ``write_pairs`` leaves."""
    pairs = (
        spark.read.schema(PAIR)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", "{*.jsonl,part-*.json}")
        .option("recursiveFileLookup", "true")
        .json(folder)
    )
    if not pairs.inputFiles():
        raise FileNotFoundError(f"No pair files found in {folder}")
    return complete_pairs(pairs)


def complete_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.col("prompt") != "") & (F.col("completion") != ""))


def write_results(results: DataFrame, path: str) -> None:
    """Result rows as JSON text; data is printed even when null, error only on failure."""
    results.select(result_json().alias("value")).write.text(path)


def result_json() -> Column:
    keep_nulls = {"ignoreNullFields": "false"}
    data = F.try_parse_json("data")
    good = F.to_json(F.struct("query", data.alias("data"), "success"), keep_nulls)
    bad = F.to_json(F.struct("query", data.alias("data"), "error", "success"), keep_nulls)
    return F.when(F.coalesce(F.col("error"), F.lit("")) == "", good).otherwise(bad)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited reply chunks; their order is the chunk_idx column."""
    return spark.read.schema(CHUNK).json(path)


def memory_gb(dump: Column) -> Column:
    """S12 on a whole memory dump: struct of (ram_gb, error).

    The first line that starts with MemTotal: and has a second field counts.
    """
    fields = F.transform(
        F.filter(F.split(dump, "\n", -1), lambda line: F.startswith(line, F.lit("MemTotal:"))),
        lambda line: F.split(squeeze_ends(line), r"(?U)\s+", -1),
    )
    first = F.get(F.filter(fields, lambda f: F.size(f) >= 2), F.lit(0))
    kb = F.get(first, F.lit(1)).try_cast("bigint")
    return F.struct(
        F.floor(kb / F.lit(KB_PER_GB)).alias("ram_gb"),
        F.when(first.isNull(), F.lit("could not find MemTotal in meminfo"))
        .when(kb.isNull(), F.lit("could not parse memory value"))
        .alias("error"),
    )


def read_meminfo(spark: SparkSession, path: str) -> DataFrame:
    """(path, ram_gb, error), one row per dump file; a dump is a couple of KB."""
    dumps = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("path"), memory_gb(F.col("value")).alias("m"))
    )
    return dumps.select("path", "m.ram_gb", "m.error")
