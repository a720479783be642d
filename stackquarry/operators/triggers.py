"""What triggers a function: J09.

The answer has two tables. ``trigger_counts`` has one row per question;
``triggers_of_asked`` has the trigger rows of every function that was asked
about, once. Joining them per question would repeat a popular function's
triggers for each of its questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trigger_counts(questions: DataFrame, triggers: DataFrame) -> DataFrame:
    """questions: question_id, function_name. A function without triggers counts 0."""
    counts = triggers.groupBy("function_name").agg(F.count(F.lit(1)).alias("trigger_count"))
    return questions.join(counts, "function_name", "left").withColumn(
        "trigger_count", F.coalesce("trigger_count", F.lit(0).cast("bigint"))
    )


def triggers_of_asked(questions: DataFrame, triggers: DataFrame) -> DataFrame:
    asked = questions.select("function_name").distinct()
    return triggers.join(asked, "function_name", "left_semi")
