"""Near-duplicate documents by bottom-k sketches.

A document's set is its distinct runs of five words. One hash function orders all runs;
a document's sketch is the k least hashes of its set. Documents with equal sets form one
class, of which only the sketch goes on. Sketch values that several classes retain are
inverted to lists; of each sketch only its rarest values are listed, as many as it takes
for two similar sketches to share one. Lists are split by set size, as similar sets have
similar sizes. Pairs that a list proposes pass if the sketch of their union, which the two
sketches yield, estimates a similarity within six standard errors of the threshold; the
full sets then decide exactly.

A list is not expanded into all its pairs. One of its classes is compared with all others
(in short lists, all are with all), and links join components. Lists that then still hold
several components are settled in blocks: each of their classes goes to its longest such
list, classes of one list or of two that meet in a third are cut into blocks by hashed
ids, and every pair of blocks is compared by products of set matrices. A task yields one
link for each class at most. In the end every pair of a list was compared or lies in one
component, so no component is lost.

Defined results: a null or empty text, or one of white space only, has the empty set and
is linked with nothing. A text of fewer than five words has its whole sequence as its one
run. Rows with the same id act as one node that has the links of each of them. Rows with a
null id take no part; ``representatives`` keeps them, and all extra columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry.llm import textbatch
from stackquarry.llm.components import components
from stackquarry.llm.shared import dropped, shared_table

WORDS = 5
K = 64
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Entries of a list whose pairs are all compared at once; and classes of a block.
SHORT = 8
BLOCK = 256
#: Slots of the bitmap of listed classes.
SLOTS = 1 << 22
#: Standard errors by which an estimate or an overlap may fall short.
ERRORS = 6

SKETCHED = "doc_id long, n_shingles long, sum_key long, xor_key long, sketch array<long>"

#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 19


def _runs_by_row(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct run hashes of each text that has a word."""
    for low, _, data, offsets in textbatch.slices(*textbatch.bytes_of(texts), SLICE_BYTES):
        starts, ends, rows = textbatch.words(data, offsets)
        if not len(starts):
            continue
        hashed = textbatch.hashes(data, starts, ends, textbatch.LOWER_HASH)
        runs, at = textbatch.shingles(hashed, rows, WORDS)
        cuts = np.flatnonzero(np.diff(at)) + 1
        for row, own in zip(at[np.append(0, cuts)], np.split(runs, cuts)):
            yield low + int(row), np.unique(own)


@textbatch.lean
def _sketches(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        n = table.num_rows
        sizes = np.zeros(n, np.int64)
        sums, xors = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        least = [np.empty(0, np.int64)] * n
        for row, runs in _runs_by_row(table.column(1)):
            sizes[row] = len(runs)
            sums[row] = runs.sum()
            xors[row] = np.bitwise_xor.reduce(textbatch.mixed(runs + np.uint64(1)))
            least[row] = (runs[:K] ^ np.uint64(1 << 63)).view(np.int64)
        ends = np.cumsum([0] + [len(own) for own in least], dtype=np.int32)
        values = np.concatenate(least) if n else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                table.column(0),
                pa.array(sizes),
                pa.array(sums.view(np.int64)),
                pa.array(xors.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
            ],
            names=["doc_id", "n_shingles", "sum_key", "xor_key", "sketch"],
        )


@textbatch.lean
def _sets(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each row: its sorted run hashes as bytes."""
    for table in tables:
        sets = [b""] * table.num_rows
        for row, runs in _runs_by_row(table.column(1)):
            sets[row] = runs.tobytes()
        yield pa.RecordBatch.from_arrays([table.column(0), pa.array(sets, pa.binary())], names=["id", "runs"])


def _verify(percent: int):
    @textbatch.lean
    def verify(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            good = []
            for left, right in zip(table.column("runs_a"), table.column("runs_b")):
                left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * both >= percent * (len(left) + len(right) - both))
            yield table.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _least_overlap(size: Column, percent: int) -> Column:
    """Values that the sketch shares with that of any similar set: exact for a set that
    lies, with all similar ones, wholly in its sketch; else short by ERRORS at most."""
    j = percent / 100
    certain = F.ceil(size * j - 1e-9)
    likely = F.lit(max(1, math.floor(K * j - ERRORS * math.sqrt(K * j * (1 - j)))))
    return F.when(size < math.floor(K * j), certain).otherwise(likely)


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(list, id, n, priority): the inverted lists of at least two classes. ``n`` is the
    size of the set."""
    values = classes.select("id", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    often = shared_table(values.groupBy("value").count().where(F.col("count") > 1), "sketch-values")
    shared = values.join(often, "value").groupBy("id", "n", "k").agg(
        F.sort_array(F.collect_list(F.struct("count", "value"))).alias("found")
    )
    # The values that nobody else retains are the rarest; they take the first places.
    listed = F.col("k") - _least_overlap(F.col("k"), percent) + 1 - (F.col("k") - F.size("found"))
    shared = shared.where(listed > 0).select("id", "n", F.explode(F.slice("found", F.lit(1), listed.cast("int"))).alias("of"))
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9)
    entries = shared.select(
        F.explode(F.array(band, band + 1)).alias("band"), "of", "id", "n",
    ).select(F.xxhash64("of.value", "band").alias("list"), "id", "n", F.xxhash64("id").alias("priority"))
    entries = shared_table(entries, "sketch-lists")
    dropped(often)
    return entries


def _open_entries(entries: DataFrame, name: str) -> DataFrame:
    """Entries of lists that hold several components, with the entries of their list."""
    lists = entries.groupBy("list").agg(
        F.count("*").alias("entries"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.min(F.struct("priority", "id"))["id"].alias("first"),
    ).where(F.col("low") < F.col("high")).select("list", "entries", "first")
    return entries.join(shared_table(lists, name), "list")


def _proposed(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of the first entry of each list, or each one of a short list, with
    the other entries of a similar size."""
    opened = shared_table(_open_entries(entries.withColumn("component", F.col("id")), "lists"), "opened")
    pivots = opened.where((F.col("id") == F.col("first")) | (F.col("entries") <= SHORT))
    pivots = shared_table(pivots.select("list", F.col("id").alias("pivot"), F.col("n").alias("m")), "pivots")
    pairs = pivots.join(opened.select("list", "id", "n"), "list").where(F.col("id") != F.col("pivot"))
    pairs = pairs.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    pairs = shared_table(pairs.distinct(), "pairs")
    dropped(opened, pivots)
    return pairs


def _tasks(entries: DataFrame) -> DataFrame:
    """(id, one, other, i, j): the block pairs in which classes of open lists meet. Each
    class is at home in its longest open list; homes that share a list meet."""
    opened = _open_entries(entries, "open-lists").where(F.col("entries") > SHORT)
    opened = shared_table(opened.select("list", "id", "entries"), "open-entries")
    home = opened.groupBy("id").agg(F.max(F.struct("entries", "list"))["list"].alias("home"))
    home = shared_table(home, "homes")
    blocks = shared_table(
        home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "home-blocks"
    )
    met = opened.join(home, "id").select("list", "home").distinct()
    met = shared_table(met, "met")
    pairs = met.join(met.withColumnRenamed("home", "with"), "list").select("home", "with").distinct()
    pairs = pairs.join(blocks.withColumnsRenamed({"home": "with", "blocks": "others"}), "with")
    members = home.join(blocks, "home").select(
        "id", "home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    )
    members = members.join(pairs, "home").select(
        "id", "home", "with", "block", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other")
    )
    own, beside = F.struct("home", "block"), F.struct(F.col("with").alias("home"), F.col("other").alias("block"))
    return members.select(
        "id", F.xxhash64(F.least(own, beside), F.greatest(own, beside)).alias("task")
    ).distinct()


def _linked(percent: int):
    """Links of each class of a block pair to the least one it hangs together with."""

    def near(sets: list[np.ndarray]) -> np.ndarray:
        values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
        column = np.cumsum(count > 1) - 1
        shared = count[place] > 1
        rows, columns = rows[shared], column[place[shared]]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        both = np.zeros((len(sets), len(sets)))
        for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, 2048):
            part = slice(*np.searchsorted(columns, [low, low + 2048]))
            has = np.zeros((len(sets), 2048), np.float32)
            has[rows[part], columns[part] - low] = 1
            both += has @ has.T
        sizes = np.array([len(own) for own in sets])
        return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)

    @textbatch.lean
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        task = None

        def links() -> pa.RecordBatch:
            ids = np.array(sorted(held), np.int64)
            a, b = np.nonzero(near([held[k] for k in ids.tolist()]))
            roots, before = ids.copy(), None
            while before is None or not np.array_equal(before, roots):
                before = roots.copy()
                np.minimum.at(roots, a, before[b])
            moved = roots != ids
            return pa.RecordBatch.from_arrays([pa.array(roots[moved]), pa.array(ids[moved])], names=["a", "b"])

        for batch in batches:
            for id_, of, runs in zip(*(batch.column(name) for name in ("id", "task", "runs"))):
                if of.as_py() != task:
                    if len(held) > 1:
                        yield links()
                    held, task = {}, of.as_py()
                held[id_.as_py()] = np.frombuffer(runs.as_buffer(), np.uint64)
        if len(held) > 1:
            yield links()

    return linked


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch does not rule them out."""
    of = classes.select("id", "sketch", "n")
    a = of.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a"), F.col("n").alias("n_a"))
    b = of.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"), F.col("n").alias("n_b"))
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, K)
    both = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    j = percent / 100
    whole = (F.col("n_a") <= K) & (F.col("n_b") <= K)
    slack = F.when(whole & (F.size(union) < K), 1e-9).otherwise(ERRORS * math.sqrt(j * (1 - j) / K))
    return pairs.join(a, "a").join(b, "b").where(both / F.size(union) >= j - slack).select("a", "b")


def _slot() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")


def _perhaps(ids: DataFrame) -> Column:
    """Whether one of the ids has the row's slot. The bitmap, a constant array, has a fixed
    size; it only saves the shuffle of most texts that the join after it drops."""
    bit = F.expr("shiftleft(1L, slot & 63)")
    words = ids.select(_slot().alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = words.toPandas()
    bitmap = np.zeros(SLOTS // 64, np.int64)
    bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    constant = F.from_json(F.lit(str(bitmap.tolist())), "array<bigint>")
    return F.getbit(F.get(constant, F.shiftright(_slot(), 6)), _slot().bitwiseAND(F.lit(63))) == 1


def link_classes(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between class ids that connect all classes of a component."""
    entries = _lists(classes, percent)
    ids = shared_table(entries.select("id").distinct(), "listed")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    texts = texts.where(_perhaps(ids)).join(ids, "id", "left_semi")
    sets = shared_table(texts.mapInArrow(_sets, "id long, runs binary"), "sets")
    pairs = _proposed(entries, percent)
    likely = shared_table(_estimated(pairs, classes, percent), "likely-pairs")
    a = sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a"))
    b = sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b"))
    sound = likely.join(a, "a").join(b, "b").mapInArrow(_verify(percent), "a long, b long")
    links = shared_table(sound, "near-links")
    dropped(pairs, likely)
    labels = shared_table(components(links), "near-components")
    current = entries.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tasks = shared_table(_tasks(shared_table(current, "entries")), "tasks")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tasks.join(sets, "id").repartition(spread, "task").sortWithinPartitions("task")
    return links.unionByName(shared_table(rows.mapInArrow(_linked(percent), "a long, b long"), "block-links"))


def group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    keyed = docs.where(F.col("doc_id").isNotNull())
    sketched = keyed.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_sketches, SKETCHED)
    sketched = shared_table(sketched, "sketches")
    keys = ["n_shingles", "sum_key", "xor_key"]
    classes = sketched.where(F.col("n_shingles") > 0).groupBy(*keys).agg(
        F.min("doc_id").alias("id"), F.min("sketch").alias("sketch")
    )
    classes = shared_table(classes.select("id", F.col("n_shingles").alias("n"), *keys[1:], "sketch"), "classes")
    links = link_classes(docs, classes, percent)
    labels = shared_table(components(links), "components")
    named = classes.select(F.col("n").alias("n_shingles"), "sum_key", "xor_key", "id").join(labels, "id", "left")
    named = shared_table(named.select(*keys, F.coalesce("component", "id").alias("component_id")), "named")
    # Component ids are classes' smallest documents, so the smallest of these is right.
    out = sketched.select("doc_id", *keys).join(named, keys, "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all columns."""
    gone = group(docs, percent).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("kept"))
    gone = shared_table(gone.where(~F.col("kept")).select("gone_id"), "gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["gone_id"], "left_anti")
