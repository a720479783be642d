"""Training pairs from collected metadata: P17-P20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry import wording
from stackquarry.functions.text import fill

MAX_TOKENS = 1024


def collect_rows(functions: DataFrame) -> DataFrame:
    """Listed functions (FunctionName, FunctionArn) as metadata rows."""
    return functions.select(
        F.lit("Lambda").alias("Type"), "FunctionName", F.col("FunctionArn").alias("Arn")
    )


def make_pairs(metadata: DataFrame, completion: Column | None = None) -> DataFrame:
    """A question about each function; ``completion`` replaces the constant answer."""
    prompt = fill(wording.PAIR_PROMPT.replace("%s", "{name}"), name=F.col("FunctionName"))
    answer = F.lit(wording.PAIR_COMPLETION) if completion is None else completion
    return metadata.filter(F.col("Type") == "Lambda").select(
        prompt.alias("prompt"), answer.alias("completion")
    )


def pair_text(pairs: DataFrame) -> DataFrame:
    """P19."""
    return pairs.withColumn("text", F.concat_ws("\n", "prompt", "completion"))


def truncate_text(texts: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """P20: the first ``max_tokens`` white-space tokens as an array; ``text`` is dropped.

    The limit is the operator itself: it stands for a tokenizer's truncation.
    """
    # one more piece for an empty start and one for the unsplit rest of a long text
    tokens = F.filter(F.split("text", r"\s+", max_tokens + 2), lambda t: t != "")
    return texts.withColumn("tokens", F.slice(tokens, 1, max_tokens)).drop("text")
