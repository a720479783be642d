"""Document fingerprints by consistent weighted sampling.

A document's terms are its runs of five words, weighted by how often they occur. For each
of the signature's places, every term has two gamma(2, 1) numbers r and c and a uniform
number b, drawn from the term alone. A weight w gives t = floor(ln w / r + b), and the term
of least ln c - r (t - b) - r is sampled, with its t. Two documents sample the same pair
with probability equal to their generalised Jaccard similarity, so the share of equal
places estimates it. The numbers of a term are runs of three long random tables, from a
place that the term's hash names; the kept value is that of the sampled pair, as 16 bits.

A document's edited text takes the beginning of the next document, in descending ids. Ids
are cut into ranges; every range is sorted by itself, and the first document of each range
is also sent to the one before it, so texts are shuffled once.

Defined results: a null text is empty. A text of fewer than five words has its whole
sequence as its one term, and one without words has none: its fingerprint is that of an
empty set, alike (1) only to itself. Rows that repeat an id follow each other by text. A
null id comes last. A single document is its own next. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackquarry.llm import textbatch

WORDS = 5
#: Places of a signature.
SAMPLES = 64
#: Entries of the random tables.
TABLE = 1 << 22
SEED = 2010
#: Ranges of ids for each shuffle partition, so that hashing spreads them evenly.
RANGES = 4
#: Characters of texts whose signatures are computed together.
BATCH = 2 << 20

FINGERPRINTED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """ln c, r, b, and the value of a term of weight 1 (there t is 0), each one float per
    place in the table."""
    draw = np.random.default_rng(SEED)
    n = TABLE + SAMPLES

    def gamma() -> np.ndarray:
        return -np.log(1 - draw.random(n, np.float32)) - np.log(1 - draw.random(n, np.float32))

    r, log_c, b = gamma(), np.log(gamma()), draw.random(n, np.float32)
    return log_c, r, b, log_c + r * b - r


def signatures(terms: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """A row of SAMPLES 16-bit values for each of ``n`` documents; ``rows``, in order,
    tells whose the terms are."""
    out = np.full((n, SAMPLES), 0xFFFF, np.uint16)
    if not len(terms):
        return out
    log_c, r, b, ones = (np.lib.stride_tricks.sliding_window_view(t, SAMPLES) for t in _tables())
    at = (terms % np.uint64(TABLE)).astype(np.int64)
    firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    cuts = np.append(firsts, len(rows))
    low = 0
    while low < len(firsts):
        # As many documents as have 16,384 terms; a longer one in parts of that many.
        high = max(int(np.searchsorted(cuts, cuts[low] + 16384, "right")) - 1, low + 1)
        least = None
        for begin in range(cuts[low], cuts[high], 16384):
            end = min(begin + 16384, cuts[high])
            values = ones[at[begin:end]]
            heavy = np.flatnonzero(weights[begin:end] > 1)
            if len(heavy):
                own = at[begin:end][heavy]
                logs = np.log(weights[begin:end][heavy]).astype(np.float32)[:, None]
                t = np.floor(logs / r[own] + b[own])
                values[heavy] = log_c[own] - r[own] * (t - b[own]) - r[own]
            part = np.minimum.reduceat(values, np.maximum(cuts[low:high], begin) - begin)
            least = part if least is None else np.minimum(least, part)
        bits = np.ascontiguousarray(least, np.float32).view(np.uint32).astype(np.uint64)
        out[rows[firsts[low:high]]] = (textbatch.mixed(bits) >> np.uint64(48)) % np.uint64(0xFFFF)
        low = high
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """The signature of each text."""
    found = []
    for low, high, data, offsets in textbatch.slices(*textbatch.bytes_of(pa.array(texts, pa.large_string()))):
        starts, ends, rows = textbatch.words(data, offsets)
        if not len(starts):
            found.append(signatures(np.empty(0, np.uint64), np.empty(0), rows, high - low))
            continue
        runs, at = textbatch.shingles(textbatch.hashes(data, starts, ends), rows, WORDS)
        order = np.lexsort((runs, at))
        runs, at = runs[order], at[order]
        firsts = np.flatnonzero(np.append(True, (runs[1:] != runs[:-1]) | (at[1:] != at[:-1])))
        weights = np.diff(np.append(firsts, len(runs)))
        found.append(signatures(runs[firsts], weights, at[firsts], high - low))
    return np.concatenate(found) if found else np.empty((0, SAMPLES), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places; two empty sets are alike, an empty and another are not."""
    return (a == b).mean(1)


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range after the other, sorted; a guest ends its range."""
    rows: list[tuple] = []  # id, text, following text
    size, before = 0, None
    for batch in batches:
        for doc_id, text, range_, guest in zip(*(column.to_pylist() for column in batch.columns)):
            text = text or ""
            if before is not None and before[2] == range_:
                rows.append((before[0], before[1], text))
                size += len(before[1])
            # Only the first guest follows the range; behind it nothing is due.
            before = None if guest else (doc_id, text, range_)
            if size >= BATCH:
                yield _rows(rows)
                rows, size = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, followers = (list(column) for column in zip(*rows))
    edited = [_edited(text, following) for text, following in zip(texts, followers)]
    # The next document's signature is that of the row behind, where it is at hand.
    own = fingerprints(texts)
    lacking = [k for k in range(len(rows)) if k + 1 >= len(rows) or texts[k + 1] is not followers[k]]
    following = np.concatenate([own[1:], own[:1]])
    following[lacking] = fingerprints([followers[k] for k in lacking])
    changed = fingerprints(edited)
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(text.encode()).hexdigest() for text in edited]),
        pa.array([values.astype(">u2").tobytes().hex() for values in own]),
        pa.array([values.astype(">u2").tobytes().hex() for values in changed]),
        pa.array(likeness(own, changed)),
        pa.array(likeness(own, following)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[part.split()[0] for part in FINGERPRINTED.split(", ")])


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = docs.select("doc_id")
    n = RANGES * partitions
    cuts = ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))
    bounds = np.array(sorted({int(cut) for cut in cuts}), np.int64)

    # Ranges count up with descending ids: the last range has the least ids, and no id.
    @F.arrow_udf("int")
    def range_of(values: pa.Array) -> pa.Array:
        lowest = pc.fill_null(values, np.iinfo(np.int64).min).to_numpy()
        return pa.array(len(bounds) - np.searchsorted(bounds, lowest, "right"), pa.int32())

    ranged = docs.withColumn("range", range_of(F.col("doc_id")))
    heads = ids.withColumn("range", range_of(F.col("doc_id"))).groupBy("range").agg(
        F.max("doc_id").alias("head")
    ).orderBy("range").collect()
    if not heads:
        return spark.createDataFrame([], FINGERPRINTED)
    # One entry for each range: few, as ranges are counted by partitions. The constant
    # array is looked up by position.
    first: list[dict | None] = [None] * (len(bounds) + 1)
    for k, row in enumerate(heads):
        first[row["range"]] = {"head": row["head"], "before": heads[k - 1]["range"]}
    known = F.from_json(F.lit(json.dumps(first)), "array<struct<head:bigint,before:int>>")
    of = F.get(known, F.col("range"))
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    also = F.struct(of["before"].alias("range"), F.lit(True).alias("guest"))
    places = F.when(F.col("doc_id").eqNullSafe(of["head"]), F.array(own, also)).otherwise(F.array(own))
    placed = ranged.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.range", "at.guest")
    placed = placed.repartition(partitions, "range").sortWithinPartitions(
        "range", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()
    )
    return placed.mapInArrow(_fingerprint, FINGERPRINTED)
