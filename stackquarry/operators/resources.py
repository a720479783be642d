"""Resource tables and summaries of compiled templates: P01-P04, A01-A03.

``documents`` are rows (project, stack, doc) with doc the template text. Each
stage explodes inside one row, so only the counts shuffle, after a partial
count on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry.functions import variants
from stackquarry.functions.text import bind, label_of_kind
from stackquarry.schemas import TEMPLATE
from stackquarry.wording import KEY_RESOURCES

KEYS = ["project", "stack"]


def decode_templates(documents: DataFrame) -> DataFrame:
    """(project, stack, template) with template NULL-valued fields when unparsable."""
    return documents.select(*KEYS, F.from_json("doc", TEMPLATE).alias("template"))


def resource_type(body: Column) -> Column:
    """The Type of an entry when it is a text, else NULL."""
    return variants.text_or_null(body, "$.Type")


def resource_entries(templates: DataFrame) -> DataFrame:
    """One row per entry under Resources: type NULL unless it is an object with a text Type.

    The outer form, with a filter behind it, keeps Spark from testing the map below the
    projection, which would parse every document once more for each test.
    """
    entries = templates.select(*KEYS, F.explode_outer("template.Resources").alias("logical_id", "body"))
    return entries.filter(F.col("logical_id").isNotNull()).select(
        *KEYS,
        "logical_id",
        resource_type(F.col("body")).alias("type"),
        variants.field(F.col("body"), "$.Properties").alias("properties"),
    )


def key_kind(type_name: Column) -> Column:
    """Display name of the four key kinds, NULL for other types."""
    return label_of_kind(type_name, [(name, label) for name, label, _ in KEY_RESOURCES])


def own_name(type_name: Column, properties: Column) -> Column:
    """The name property of a key kind when it is a text, else NULL."""
    name = F.lit(None).cast("string")
    for known, _, prop in reversed(KEY_RESOURCES):
        name = F.when(type_name == known, variants.text_or_null(properties, f"$.{prop}")).otherwise(name)
    return name


def key_label(kind: Column, name: Column, logical_id: Column) -> Column:
    named = F.concat(kind, F.lit(": "), name, F.lit(" ("), logical_id, F.lit(")"))
    return F.coalesce(named, F.concat(kind, F.lit(": "), logical_id))


def typed_resources(resources: DataFrame) -> DataFrame:
    """P01."""
    return resources.filter(F.col("type").isNotNull())


def key_resources(resources: DataFrame) -> DataFrame:
    """P02 with P03: the four key kinds, with a readable label."""
    found = resources.filter(F.col("type").isin([k[0] for k in KEY_RESOURCES])).select(
        *KEYS,
        "logical_id",
        "type",
        key_kind(F.col("type")).alias("kind"),
        own_name(F.col("type"), F.col("properties")).alias("_name"),
    )
    return found.select(
        *KEYS,
        "logical_id",
        "type",
        "kind",
        F.coalesce("_name", "logical_id").alias("friendly_name"),
        key_label(F.col("kind"), F.col("_name"), F.col("logical_id")).alias("label"),
    )


def stack_outputs(templates: DataFrame) -> DataFrame:
    """One row per output name; stacks without outputs give none."""
    names = templates.select(*KEYS, F.explode_outer(F.map_keys("template.Outputs")).alias("output_name"))
    return names.filter(F.col("output_name").isNotNull())


def stack_totals(templates: DataFrame) -> DataFrame:
    """A01 and A03 per stack, straight from the map sizes: no shuffle."""
    return templates.select(
        *KEYS,
        F.coalesce(F.size(F.map_keys("template.Resources")), F.lit(0)).cast("bigint").alias("resource_total"),
        F.coalesce(F.size(F.map_keys("template.Outputs")), F.lit(0)).cast("bigint").alias("output_total"),
    )


def resources_by_type(resources: DataFrame, *by: str) -> DataFrame:
    """Count per type, optionally per further columns; untyped entries do not count."""
    return typed_resources(resources).groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))


def scan_summary(documents: DataFrame) -> DataFrame:
    """The summary of a scan as rows (project, stack, section, item, n): the total, the
    count per type, the key resources and the outputs of each stack.

    A template is parsed once; its types are sorted and their runs counted within the row, in
    time linear in its entries but for the sort. All its lines come out of one explode, without
    an exchange.
    """

    def line(section: str, item: Column, n: Column | None = None) -> Column:
        count = F.lit(1) if n is None else n
        return F.struct(
            F.lit(section).alias("section"), item.alias("item"), count.cast("bigint").alias("n")
        )

    def typed(entry: Column) -> Column:
        return F.struct(
            entry["key"].alias("logical_id"),
            entry["value"].alias("body"),
            resource_type(entry["value"]).alias("type"),
        )

    def key_line(entry: Column) -> Column:
        properties = variants.field(entry["body"], "$.Properties")
        name = own_name(entry["type"], properties)
        return line("key", key_label(key_kind(entry["type"]), name, entry["logical_id"]))

    def type_lines(types: Column) -> Column:
        """A line per run of equal types in sorted order."""
        n = F.size(types)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(types, i) != F.get(types, i - 1)))
        return F.when(n > 0, bind(starts, lambda starts: F.transform(
            starts, lambda i, k: line("type", F.get(types, i), F.coalesce(F.get(starts, k + 1), n) - i)
        )))

    def lines_of(entries: Column) -> Column:
        types = F.array_sort(F.filter(F.transform(entries, lambda entry: entry["type"]), lambda name: name.isNotNull()))
        return F.concat(
            F.array(line("total", F.lit("resources"), F.coalesce(F.size(entries), F.lit(0)))),
            F.coalesce(bind(types, type_lines), none),
            F.coalesce(F.transform(entries, key_line), none),
            F.coalesce(outputs, none),
        )

    entries = F.transform(F.map_entries("template.Resources"), typed)
    outputs = F.transform(F.map_keys("template.Outputs"), lambda name: line("output", name))
    none = F.array().cast("array<struct<section:string,item:string,n:bigint>>")
    return (
        decode_templates(documents)
        .select(*KEYS, F.explode_outer(bind(entries, lines_of)).alias("line"))
        .select(*KEYS, "line.section", "line.item", "line.n")
        .filter(F.col("item").isNotNull())
    )
