"""Redaction and restoring of sensitive identifiers: F04, W02 and the text half of J07.

One running index counts placeholders across the patterns in order, first over
the question, then over its context. The index, the map and both texts travel in
one row, so redaction never shuffles.

No pattern reads the number inside a placeholder (digits after a word character start no
match), so a text that many questions share is redacted once, into the pieces between its
placeholders; each question then only adds its own count to their numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry.functions.text import bind
from stackquarry.wording import PLACEHOLDER, REDACTIONS

#: Stands before placeholders that redaction has put in; where a text has the character
#: itself, its double stands for it while redaction runs.
MARK, KEPT = "\u0001", "\u0001\u0002"
MAP_TYPE = "ARRAY<STRUCT<idx: INT, tag: STRING, placeholder: STRING, original: STRING>>"


def _interleave(pieces: Column, fillers: Column) -> Column:
    """piece, filler, piece, filler, ..., piece as one text."""
    return F.array_join(
        F.zip_with(pieces, fillers, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), ""
    )


def scrub(
    df: DataFrame,
    texts: list[str],
    out_prefix: str = "scrubbed_",
    map_column: str = "redactions",
) -> DataFrame:
    """Add ``scrubbed_<name>`` per text column, in the given order, and the map column."""
    none = F.from_json(F.lit("[]"), MAP_TYPE)
    state = _state(F.lit(None).cast("string"), F.lit(0), none, F.lit(None).cast("array<string>"))
    for name in texts:
        state = bind(state, _next_text(F.col(name)))
        for tag, pattern, hint in REDACTIONS:
            state = bind(state, _replacing(tag, pattern, hint))
    finished = bind(state, _next_text(F.lit(None).cast("string")))
    return df.withColumn("_scrubbed", finished).select(
        *df.columns,
        *[
            F.get(F.col("_scrubbed")["done"], F.lit(i)).alias(out_prefix + name)
            for i, name in enumerate(texts, start=1)
        ],
        F.col("_scrubbed")["entries"].alias(map_column),
    )


def _state(text: Column, seen: Column, entries: Column, done: Column) -> Column:
    return F.struct(
        text.alias("text"), seen.alias("seen"), entries.alias("entries"), done.alias("done")
    )


def _next_text(text: Column) -> Callable[[Column], Column]:
    """Put the finished text aside and go on with ``text``."""
    return lambda s: _state(
        text,
        s["seen"],
        s["entries"],
        F.concat(F.coalesce(s["done"], F.array().cast("array<string>")), F.array(s["text"])),
    )


def _replacing(tag: str, pattern: str, hint: str | None, mark: str = "") -> Callable[[Column], Column]:
    """One pattern's step on the state. A text without ``hint`` skips the pattern; ``mark``
    goes before each placeholder in the text."""

    def step(state: Column) -> Column:
        found = F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0))
        if hint:
            found = F.when(F.contains(state["text"], F.lit(hint)), found)
        return bind(
            F.transform(found, lambda original, i: _entry(state["seen"] + i + 1, tag, original)),
            lambda entries: F.when(
                F.size(entries) > 0,
                _state(
                    _interleave(
                        F.split(state["text"], pattern, -1),
                        F.transform(entries["placeholder"], lambda p: F.concat(F.lit(mark), p)) if mark else entries["placeholder"],
                    ),
                    state["seen"] + F.size(entries),
                    F.concat(state["entries"], entries),
                    state["done"],
                ),
            ).otherwise(state),
        )

    return step


def _entry(number: Column, tag: str | Column, original: Column) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.struct(
        number.cast("int").alias("idx"),
        tag.alias("tag"),
        F.concat(F.lit("[["), tag, F.lit("_"), number.cast("string"), F.lit("]]")).alias("placeholder"),
        original.alias("original"),
    )


def text_pieces(text: Column) -> Column:
    """A text redacted on its own, as a struct: ``pieces`` between its placeholders,
    ``places`` (the number of the placeholder between each two) and ``found`` (tag and
    original by number). NULL for NULL."""
    none = F.from_json(F.lit("[]"), MAP_TYPE)
    state = _state(F.replace(text, F.lit(MARK), F.lit(KEPT)), F.lit(0), none, F.lit(None).cast("array<string>"))
    for tag, pattern, hint in REDACTIONS:
        state = bind(state, _replacing(tag, pattern, hint, MARK))
    marked = MARK + PLACEHOLDER

    def parts(s: Column) -> Column:
        return F.struct(
            F.transform(F.split(s["text"], marked, -1), lambda p: F.replace(p, F.lit(KEPT), F.lit(MARK))).alias("pieces"),
            F.transform(
                F.regexp_extract_all(s["text"], F.lit(marked), F.lit(0)),
                lambda p: F.regexp_extract(p, r"_(\d+)\]", 1).cast("int"),
            ).alias("places"),
            F.transform(s["entries"], lambda e: F.struct(e["tag"], e["original"])).alias("found"),
        )

    return F.when(text.isNotNull(), bind(state, parts))


def numbered_text(parts: Column, seen: Column) -> Column:
    """The redacted text of ``text_pieces`` where ``seen`` placeholders come before its own."""

    def placeholder(place: Column) -> Column:
        return F.concat(F.lit("[["), F.get(parts["found"], place - 1)["tag"], F.lit("_"), (place + seen).cast("string"), F.lit("]]"))

    return F.when(F.size(parts["places"]) == 0, F.get(parts["pieces"], F.lit(0))).otherwise(
        _interleave(parts["pieces"], F.transform(parts["places"], placeholder))
    )


def numbered_entries(parts: Column, seen: Column) -> Column:
    """The map entries of ``text_pieces`` where ``seen`` placeholders come before its own."""
    return F.transform(parts["found"], lambda e, i: _entry(seen + i + 1, e["tag"], e["original"]))


def unscrub(text: Column, redactions: Column) -> Column:
    """Put originals back. Entry n of the map has index n, so look-up is by position.

    Originals never hold a bracket, so one pass equals replacing entry by entry.
    """

    def restored(placeholder: Column) -> Column:
        number = F.regexp_extract(placeholder, r"_(\d+)\]", 1).try_cast("int")
        entry = F.get(redactions, number - 1)
        return F.when(entry["placeholder"] == placeholder, entry["original"]).otherwise(placeholder)

    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    return F.when(
        F.contains(text, F.lit("[[")) & (F.size(redactions) > 0),
        _interleave(F.split(text, PLACEHOLDER, -1), F.transform(found, restored)),
    ).otherwise(text)


def redaction_rows(df: DataFrame, key: str, map_column: str = "redactions") -> DataFrame:
    """The map as a side table (key, idx, tag, placeholder, original).

    The outer form keeps Spark from testing the array's size below the redaction,
    which would run the redaction twice.
    """
    return df.select(key, F.inline_outer(map_column)).filter(F.col("idx").isNotNull())


def unscrub_with_rows(answers: DataFrame, rows: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """J07 against a stored side table: a request's map is gathered, then joined.

    What is gathered per key is the map of one request, which came out of one
    row's text; it cannot outgrow a row.
    """
    maps = rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("idx", "tag", "placeholder", "original"))).alias("_map")
    )
    joined = answers.join(maps, key, "left")
    restored = F.coalesce(unscrub(F.col(text), F.col("_map")), F.col(text))
    return joined.withColumn(out, restored).drop("_map")
