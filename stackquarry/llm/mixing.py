"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight and gets that share of all words, at most ``most_copies`` times
its own words; what it cannot take goes to the others by weight. A source that takes more
words than it has gets whole copies of every document first. The rest of its target is a
sample without replacement: each document draws a uniform number from its id, the odds of
that number are divided by the odds of its inclusion probability, and documents are taken
in this order until the words come nearest to the target. The order needs no global sort:
ranks are counted in two levels of bins, and only the documents of one second-level bin
of a source are sorted.

Defined results: a null or empty text, or one of white space only, has size 0 and takes
nothing. A null source is a source of its own, the last. Rows of one id in one source, and
rows without an id, are numbered by size and content, and each draws a number of its own, so
they don't tie; equal ones are taken in any choice of them. An empty table gives an empty
result. Extra columns stay with their rows in the mix and are not part of the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackquarry.llm.shared import shared_table
from stackquarry.operators.ordered import join_same, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix"
#: Bins of the sampling order at each of the two levels.
BINS = 4096

#: An inclusion probability stays below 1; the whole copies are the certain part.
MOST_CHANCE = 0.999


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, nth: Column) -> Column:
    """A number in (0, 1) drawn from the id and the row's number under it: the first 52 bits
    of a digest."""
    name = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    digits = F.substring(F.md5(F.when(nth > 0, F.concat(name, F.lit(":"), nth.cast("string"))).otherwise(name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def measure(size: Column) -> Column:
    """What a document's chance is proportional to: the binary digits of its size."""
    return F.length(F.bin(size)).cast("double")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, content) with ``nth``, from 0 on, in place of
    ``content``. Only rows that share their id are sorted, over the cluster: however many
    they are, they spread over chunks."""
    key = ["source", "doc_id"]
    repeated = shared_table(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "mix-repeated")
    if repeated.isEmpty():
        return rows.drop("content").withColumn("nth", F.lit(0).cast("bigint"))
    once = join_same(rows, repeated, key, "left_anti").withColumn("nth", F.lit(0).cast("bigint"))
    several = join_same(rows, repeated, key, "left_semi").withColumns(
        {"_one": F.lit(1).cast("bigint"), "_id": F.monotonically_increasing_id()}
    )
    several = running_total(several, key, ["size", "content", "_id"], "_one", "nth").drop("_one", "_id")
    return once.unionByName(several.withColumn("nth", F.col("nth") - 1)).drop("content")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: words, mean measure of a word's document, weight and target.
    Sources are few against documents; the windows here run over their sums."""
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * measure(F.col("size"))).alias("measured")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), turn.cast("int")).cast("double")
    most = (F.col("source_size") * MOST_COPIES).cast("double")
    sources = sources.select("*", weight.alias("weight"), most.alias("most"))
    # A source is full at the level most / weight. Going up these levels, the words left
    # over the weights left are the level of all sources that are not full yet.
    weight, most = F.col("weight"), F.col("most")
    everything = Window.partitionBy(F.lit(1))
    upto = everything.orderBy(most / weight, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    words_left = F.sum("source_size").over(everything) - (F.sum(most).over(upto) - most)
    weights_left = F.sum(weight).over(everything) - (F.sum(weight).over(upto) - weight)
    sources = sources.select("*", (words_left / weights_left).alias("level"))
    level = F.max(F.when(F.col("level") <= most / weight, F.col("level"))).over(everything)
    target = F.least(most, level * weight)
    return sources.select("source", "source_size", "measured", target.alias("target"))


def _matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Add to ``left`` the columns of ``right``, a written table with one row a source:
    Spark broadcasts it while its files are small."""
    right = right.withColumnRenamed("source", "right_source")
    return left.join(right, left["source"].eqNullSafe(right["right_source"]), "left").drop("right_source")


def _placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``sizes`` with target, whole copies, words still wanted and place in the order."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(F.floor(ratio), F.lit(MOST_COPIES)).cast("bigint")
    part = F.when(copies >= MOST_COPIES, 0.0).otherwise(ratio - copies)
    mean = F.greatest(F.col("measured"), F.lit(1.0)) / F.greatest(F.col("source_size"), F.lit(1))
    chance = F.least(part * measure(F.col("size")) / mean, F.lit(MOST_CHANCE))
    drawn = uniform(F.col("doc_id"), F.col("nth"))
    # Odds over odds, score, as score / (1 + score): a number from 0 to 1.
    above, below = drawn * (1 - chance), (1 - drawn) * chance
    place = F.coalesce(above / (above + below), F.lit(1.0))
    wanted = F.when(copies >= MOST_COPIES, 0.0).otherwise(F.col("target") - copies * F.col("source_size"))
    placed = _matched(sizes, targets).select(
        "*", copies.alias("copies"), wanted.alias("wanted"), place.alias("place")
    )
    last = BINS * BINS - 1
    return placed.withColumn("index", F.least(F.floor(F.col("place") * BINS * BINS), F.lit(last)))


def _reached(placed: DataFrame, bin_: Column) -> DataFrame:
    """Per source: the first bin in which the words reach what is wanted (null if they
    never do), and the words before it. Documents are summed up by source and bin."""
    sums = placed.groupBy("source", bin_.alias("bin")).agg(
        F.sum("size").alias("words"), F.first("wanted").alias("wanted")
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("*", F.sum("words").over(upto).alias("through"))
    reached = F.col("through") >= F.col("wanted")
    return sums.groupBy("source").agg(
        F.min(F.when(reached, F.col("bin"))).alias("bin"),
        F.min(F.when(reached, F.col("through") - F.col("words"))).alias("before"),
    )


def cutoffs(sizes: DataFrame) -> DataFrame:
    """One row per source: its target, and how far the sample goes in the order: every
    document of an index below ``cut_index``, and those up to the place ``cut_place``."""
    targets = shared_table(source_targets(sizes), "mix-targets")
    placed = _placed(sizes, targets)
    outer = shared_table(_reached(placed, F.floor(F.col("index") / BINS)), "mix-outer")
    inside = _matched(placed, outer.withColumnRenamed("bin", "outer_bin"))
    inside = inside.where(F.floor(F.col("index") / BINS) == F.col("outer_bin"))
    inside = inside.withColumn("wanted", F.col("wanted") - F.col("before")).drop("before")
    inner = shared_table(_reached(inside, F.col("index")), "mix-inner")
    # Only the documents of the one border bin of each source meet in this window. The
    # last of them is taken where that comes nearer to the target than leaving it.
    border = _matched(inside, inner).where(F.col("index") == F.col("bin"))
    upto = Window.partitionBy("source").orderBy("place", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, 0)
    border = border.select("*", F.sum("size").over(upto).alias("through"))
    nearest = F.col("through") + F.col("before") - F.col("size") / 2 <= F.col("wanted")
    last = border.where(nearest).groupBy("source").agg(F.max("place").alias("cut_place"))
    outer = outer.select("source", F.col("bin").alias("outer_bin"))
    inner = inner.select("source", F.col("bin").alias("cut_index"))
    found = _matched(_matched(_matched(targets, outer), inner), shared_table(last, "mix-last"))
    everything = F.when(F.col("outer_bin").isNull(), F.lit(BINS * BINS)).otherwise(F.col("cut_index"))
    return shared_table(found.withColumn("cut_index", everything).drop("outer_bin"), "mix-cutoffs")


def with_copies(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, size) with source_size, target and n_copies."""
    placed = _placed(docs, cuts)
    sampled = (F.col("index") < F.col("cut_index")) | (F.col("place") <= F.col("cut_place"))
    more = F.when((F.col("wanted") > 0) & F.coalesce(sampled, F.lit(False)), 1).otherwise(0)
    return placed.withColumn("n_copies", F.col("copies") + more).drop(
        "copies", "wanted", "place", "index", "cut_index", "cut_place", "measured", "nth"
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))
    sizes = shared_table(numbered(shared_table(sizes, "mix-rows")), "mix-sizes")
    mixed = with_copies(sizes, cutoffs(sizes))
    taken = (F.col("size") * F.col("n_copies")).cast("bigint")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as taken."""
    columns = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in columns]).alias("row"),
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("content"),
    )
    sizes = shared_table(numbered(shared_table(rows.drop("row"), "mix-rows")), "mix-sizes")
    mixed = with_copies(numbered(rows), cutoffs(sizes))
    repeats = F.array_repeat(F.lit(0), F.col("n_copies").cast("int"))
    return mixed.select("row", F.explode(repeats).alias("copy")).select("row.*")
