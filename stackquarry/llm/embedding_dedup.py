"""Near-duplicate vectors by random-hyperplane signs in several tables.

Rows with equal vectors and labels form one class, of which one vector goes on with the
number of its copies. In each table a class falls into the bucket that the signs of its
products with some random planes spell. Planes and tables follow from the number of
classes, so that buckets stay small and a pair at the threshold meets in at least one
table with the stated probability. Buckets of several classes are cut into blocks by
hashed ids; every pair of blocks is compared by one matrix product, so a bucket of any
size is spread over tasks. A pair counts in the first table where it meets. A block yields
for each of its classes how many vectors it links and one link to the least class it hangs
together with, never its pairs; links then join to connected components.

Defined results: a null label, a null or empty vector, a zero vector and one with a null or
non-finite component link with nothing. Vectors of different lengths never link. Rows
that repeat an id are vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackquarry.llm.components import components
from stackquarry.llm.shared import shared_table

THRESHOLD = 0.93
#: Chance that a pair at the threshold meets in a table.
RECALL = 0.998
#: Classes that share a bucket by chance, about; and the most of one block.
BUCKET = 8
BLOCK = 256
SEED = 930


def plan(n_classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Planes of a table, and tables."""
    planes = max(8, min(16, round(math.log2(max(n_classes, 1) / BUCKET + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _codes(planes: int, tables: int):
    """Add to each row its bucket number in every table."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(planes)
        for batch in batches:
            vectors = [np.array(v.values, dtype=float) for v in batch.column("vector")]
            for vector in vectors:
                n = len(vector)
                if n not in drawn:
                    drawn[n] = np.random.default_rng([SEED, n]).standard_normal((n, planes * tables))
            rows: dict[int, np.ndarray] = {}
            for n in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == n]
                signs = (np.stack([vectors[k] for k in at]) @ drawn[n]) >= 0
                found = (signs.reshape(len(at), tables, planes) * powers).sum(2)
                rows |= dict(zip(at, found))
            out = [rows[k].tolist() for k in range(len(vectors))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "codes"]
            )

    return codes


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with the same key; a run may go on over batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and not np.array_equal(keys[low], key):
                yield pa.Table.from_batches(held)
                held = []
            key = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_out, links_out, roots_out = [], [], []
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            vectors = group.column("vector").combine_chunks()
            unit = np.asarray(vectors.flatten(), dtype=float).reshape(len(vectors), -1)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            block = group.column("block").to_numpy()
            if i != j:
                near &= block[:, None] != block[None, :]
            if not near.any():
                continue
            ids, table = group.column("id").to_numpy(), group.column("table")[0].as_py()
            a, b = np.nonzero(near)
            if table:
                codes = np.asarray(group.column("codes").combine_chunks().flatten()).reshape(len(ids), -1)[:, :table]
                for low in range(0, len(a), 65536):
                    part = slice(low, low + 65536)
                    near[a[part], b[part]] = ~(codes[a[part]] == codes[b[part]]).any(1)
                a, b = np.nonzero(near)
            copies = group.column("copies").to_numpy()
            linked = np.bincount(a, copies[b], len(ids)).astype(np.int64)
            roots = ids.copy()
            while len(a):
                before = roots.copy()
                np.minimum.at(roots, a, before[b])
                if np.array_equal(before, roots):
                    break
            found = np.flatnonzero(linked)
            ids_out.append(ids[found])
            links_out.append(linked[found])
            roots_out.append(roots[found])
            if sum(map(len, ids_out)) > 100_000:
                yield _rows(ids_out, links_out, roots_out)
                ids_out, links_out, roots_out = [], [], []
        if ids_out:
            yield _rows(ids_out, links_out, roots_out)

    return compare


def _rows(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["id", "linked", "root"])


def group(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vec_id, embedding, label."""
    embedding = F.col("embedding")
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    sound = F.col("label").isNotNull() & finite & F.exists(embedding, lambda x: x != 0)
    keyed = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "label",
        F.when(F.coalesce(sound, F.lit(False)), F.transform(embedding, lambda x: x + F.lit(0).cast("float"))).alias("vector"),
    ).withColumn("key", F.when(F.col("vector").isNotNull(), F.sha2(F.to_json(F.struct("label", "vector")), 256)))
    keyed = shared_table(keyed, "vectors")
    classes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = shared_table(classes, "vector-classes")
    planes, tables = plan(classes.count(), threshold, recall)
    first = keyed.join(classes, (keyed["vec_id"] == classes["id"]) & (keyed["key"] == classes["key"])).select(
        "id", "copies", "label", "vector"
    ).dropDuplicates(["id"])
    coded = first.mapInArrow(
        _codes(planes, tables),
        first.select("id", "copies", "label", "vector").schema.add("codes", T.ArrayType(T.IntegerType())),
    )
    coded = shared_table(coded, "vector-codes")
    placed = coded.select(
        "id", "label", F.size("vector").alias("n"), F.posexplode("codes").alias("table", "code")
    ).select("id", "table", F.xxhash64("label", "n", "table", "code").alias("bucket"))
    full = placed.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    full = shared_table(full, "vector-buckets")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = placed.join(full, "bucket").select(
        "id", "table", "bucket", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")
    )
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = members.select("id", "table", "bucket", "block", others).select(
        "id", "table", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    rows = members.join(coded, "id").select("bucket", "i", "j", "table", "block", "id", "copies", "vector", "codes")
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(spread, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = shared_table(rows.mapInArrow(_compare(threshold), "id long, linked long, root long"), "vector-links")
    labels = shared_table(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "vector-components")
    counts = found.groupBy("id").agg(F.sum("linked").alias("linked"))
    named = classes.join(counts, "id", "left").join(labels, "id", "left").select(
        "key",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    named = shared_table(named, "vector-named")
    return keyed.join(named, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
