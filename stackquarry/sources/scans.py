"""Reading compiled projects: S01-S03.

A project is a folder with ``cdk.out/manifest.json`` and the template files the
manifest names. Each file is one row, so reading is spread over tasks by file
and nothing is listed or parsed on the driver beyond Spark's own file index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackquarry.functions import variants
from stackquarry.operators.resources import decode_templates, resource_entries
from stackquarry.schemas import MANIFEST
from stackquarry.wording import SCAN_MESSAGES, STACK_ARTIFACT

BUILD_FOLDER = "cdk.out"
_PROJECT_OF = rf"^(?:file:/*(?=/))?(.*)/{BUILD_FOLDER}/"
_FILE_OF = rf"/{BUILD_FOLDER}/(.*)$"


def build_files(spark: SparkSession, root: str) -> DataFrame:
    """(project, file) of every JSON file in a build folder; contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(root)
        .select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))
    )
    return _located(listed, "path").select("project", "file")


def _located(df: DataFrame, path: str) -> DataFrame:
    return df.withColumns(
        {
            "project": F.regexp_extract(path, _PROJECT_OF, 1),
            "file": F.regexp_extract(path, _FILE_OF, 1),
        }
    ).filter(F.col("file") != "")


def _texts(spark: SparkSession, root: str, name_filter: str) -> DataFrame:
    files = (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_filter)
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), "value")
        .withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
    )
    return _located(files, "path").select("project", "file", F.col("value").alias("text"))


def manifest_texts(spark: SparkSession, root: str) -> DataFrame:
    """(project, text) of every cdk.out/manifest.json under ``root``."""
    return (
        _texts(spark, root, "manifest.json")
        .filter(F.col("file") == "manifest.json")
        .select("project", "text")
    )


def template_texts(spark: SparkSession, root: str) -> DataFrame:
    """(project, template_file, text) of every other JSON file in a build folder."""
    return (
        _texts(spark, root, "*.json")
        .filter(F.col("file") != "manifest.json")
        .select("project", F.col("file").alias("template_file"), "text")
    )


def stack_artifacts(manifests: DataFrame) -> DataFrame:
    """(project, stack, template_file) for every stack artifact of every manifest."""
    artifacts = manifests.select(
        "project", F.explode(F.from_json("text", MANIFEST)["artifacts"]).alias("stack", "artifact")
    )
    return artifacts.filter(F.col("artifact.type") == STACK_ARTIFACT).select(
        "project", "stack", F.col("artifact.properties.templateFile").alias("template_file")
    )


def first_stacks(artifacts: DataFrame) -> DataFrame:
    """One stack per project: the one with the smallest artifact id."""
    return artifacts.groupBy("project").agg(
        F.min("stack").alias("stack"), F.min_by("template_file", "stack").alias("template_file")
    )


def stack_documents(artifacts: DataFrame, templates: DataFrame) -> DataFrame:
    """(project, stack, doc); doc is NULL when the template file is missing."""
    return artifacts.join(templates, ["project", "template_file"], "left").select(
        "project", "stack", "template_file", F.col("text").alias("doc")
    )


def scan_outcomes(
    projects: DataFrame, files: DataFrame, manifests: DataFrame, templates: DataFrame
) -> DataFrame:
    """One row per stack that could be read, one error row per fault.

    Columns project, stack, doc, error_code, error. A project with a fault in one
    stack keeps its good stacks.
    """
    built = files.select("project").distinct().withColumn("_built", F.lit(True))
    state = (
        projects.select("project")
        .join(built, "project", "left")
        .join(manifests, "project", "left")
        .withColumn("_manifest", F.try_parse_json("text"))
    )
    stacks = F.filter(
        F.map_entries(F.from_json("text", MANIFEST)["artifacts"]),
        lambda a: a["value"]["type"] == STACK_ARTIFACT,
    )
    listed = state.select(
        "project",
        F.when(F.col("_built").isNull(), F.lit("no_build_output"))
        .when(F.col("text").isNull(), F.lit("manifest_unreadable"))
        .when(~_manifest_fits(F.col("_manifest")), F.lit("manifest_unparsable"))
        .when(F.coalesce(F.size(stacks), F.lit(0)) <= 0, F.lit("no_stack"))
        .alias("error_code"),
        F.explode_outer(stacks).alias("artifact"),
    ).select(
        "project",
        F.col("artifact.key").alias("stack"),
        F.coalesce("artifact.value.properties.templateFile", F.lit("")).alias("template_file"),
        "error_code",
    )
    documents = listed.join(
        templates.withColumnRenamed("text", "doc"), ["project", "template_file"], "left"
    )
    code = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("doc").isNull(), F.lit("template_unreadable"))
        .when(~variants.decodes_as_object(F.try_parse_json("doc")), F.lit("template_unparsable"))
    )
    return documents.withColumn("error_code", code).select(
        "project",
        "stack",
        F.when(F.col("error_code").isNull(), F.col("doc")).alias("doc"),
        "error_code",
        _message().alias("error"),
    )


def built_documents(spark: SparkSession, root: str) -> DataFrame:
    """(project, stack, doc) of every readable stack below ``root``."""
    artifacts = stack_artifacts(manifest_texts(spark, root))
    return stack_documents(artifacts, template_texts(spark, root)).filter(F.col("doc").isNotNull())


def scan_resources(
    spark: SparkSession,
    path: str,
    provider: Callable[[SparkSession, str], DataFrame] = built_documents,
) -> DataFrame:
    """Resource rows of whatever ``provider`` finds at ``path``.

    A provider is a function (spark, path) -> DataFrame(project, stack, doc).
    """
    documents = provider(spark, path).select("project", "stack", "doc")
    return resource_entries(decode_templates(documents))


def _manifest_fits(manifest: Column) -> Column:
    artifacts = F.try_variant_get(manifest, "$.artifacts", "map<string, variant>")
    entries_fit = F.forall(
        F.map_values(artifacts),
        lambda a: variants.text_fits(a, "$.type")
        & variants.text_fits(a, "$.properties.templateFile"),
    )
    return variants.decodes_as_object(manifest) & (
        variants.absent(manifest, "$.artifacts") | F.coalesce(entries_fit, F.lit(False))
    )


def _message() -> Column:
    """The text of each error code, with the column it names filled in."""
    code = F.col("error_code")
    return F.coalesce(
        *[
            F.when(code == name, F.format_string(text, filled) if filled else F.lit(text))
            for name, (text, filled) in SCAN_MESSAGES.items()
        ]
    )
