"""URLs by rules, and by a character language-model ratio where no rule fits.

The URLs that a rule accepts and those that a rule rejects train a Markov model each: how
often a character follows the last 0 to ORDER characters, every order smoothed by the one
below it. The counts are exact and lie in a table on all machines, by gram (a character
and those before it); it grows with the input. A part of the rows is scored at a time, by
the counts of the grams that this part has. A URL's score is the difference of its
log-likelihoods over its length. The threshold that errs least on a calibration fold, by
the counts without that fold and both classes weighing the same, parts accepted from
rejected; then the scores come from the counts of all URLs with a rule, the fold's too.

The models train on and judge the whole URL, its scheme, query and fragment too; rules see
its host and path. Defined results: a URL without ``://`` has an empty host and path, and
no rule. A null URL is an empty one, and the score of the empty URL is 0. Rows with equal
URLs have equal verdicts. While one class has no URL in
the fold the threshold is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry.llm import textbatch
from stackquarry.llm.shared import shared_table

#: Verdict, host and path of each rule.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

ORDER = 5
#: Weight of the next lower order, in characters.
SMOOTH = 4.0
#: Bins of the calibration's score histogram, over scores from -WIDEST to WIDEST.
BINS, WIDEST = 2000, 10.0

#: Parts that are scored on their own: for each shuffle partition, so that hashing spreads
#: them evenly, and the bytes of URLs from which there are more.
PARTS = 4
PART_BYTES = 256 << 10
#: Bytes of URLs counted together; a longer one by itself.
BLOCK = 256 << 10

#: A gram's key: order + 1 above its ORDER + 1 characters of 9 bits, 0 before the text, a
#: byte + 1, END behind it. ALL counts every character, END of order 0 every text.
WIDTH, END, ALL = 9, 257, 0
TEXTS = (1 << WIDTH * (ORDER + 1)) + END
COUNTS = ["rejected", "accepted", "held_rejected", "held_accepted"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda rule: -len(rule[1] + rule[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of up to BLOCK bytes and rows."""
    data, offsets = textbatch.bytes_of(texts)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + BLOCK, "right")) - 1
        high = min(max(high, low + 1), low + BLOCK, n)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the gram of each order, 0 to ORDER, that ends at each character, and the row
    of each character. A text ends with a character of its own."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    width = lengths + ORDER + 1
    begins = np.cumsum(width) - width
    padded = np.zeros(int(width.sum()), np.int64)
    rows = np.repeat(np.arange(n), lengths + 1)
    at = np.arange(len(rows)) + ORDER * (rows + 1)
    inside = np.repeat(np.arange(n), lengths)
    padded[np.arange(len(data)) - offsets[inside] + begins[inside] + ORDER] = data.astype(np.int64) + 1
    padded[begins + width - 1] = END
    keys = np.empty((ORDER + 1, len(at)), np.int64)
    seen = np.zeros(len(at), np.int64)
    for order in range(ORDER + 1):
        seen |= padded[at - order] << (WIDTH * order)
        keys[order] = seen | (order + 1) << (WIDTH * (ORDER + 1))
    return keys, rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of blocks of texts, by class, and of those in the fold."""
    for batch in batches:
        accepted, held = (batch.column(name).to_numpy(zero_copy_only=False).astype(int) for name in ("accepted", "held"))
        for low, high, data, offsets in _blocks(batch.column("text")):
            keys, rows = _grams(data, offsets)
            kind = (accepted[low:high] + 2 * held[low:high])[rows]
            found, place = np.unique(keys, return_inverse=True)
            counts = np.bincount(place.ravel() * 4 + np.tile(kind, ORDER + 1), minlength=4 * len(found)).reshape(-1, 4)
            counts = np.vstack([np.bincount(kind, minlength=4), counts]).T
            columns = [np.append(ALL, found), counts[0] + counts[2], counts[1] + counts[3], counts[2], counts[3]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", *COUNTS])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the grams that each part's texts have, and of ALL and TEXTS."""
    for batch in batches:
        parts = batch.column("part").to_numpy()
        for low, high, data, offsets in _blocks(batch.column("text")):
            keys, rows = _grams(data, offsets)
            own = parts[low:high][rows]
            order = np.argsort(own, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(own[order]) != 0))
            for begin, end in zip(begins, np.append(begins[1:], len(order))):
                found = np.union1d(keys[:, order[begin:end]], [ALL, TEXTS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), own[order[begin]], np.int32)), pa.array(found)], names=["part", "key"]
                )


def scores(texts: pa.Array, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-likelihood difference of each text over its length, its end included, by the
    counts (class, key) of the sorted ``keys``; other grams count 0."""
    out = np.zeros(len(texts))
    # Behind the last key, what no gram has.
    keys, counts = np.append(keys, np.iinfo(np.int64).max), np.hstack([counts, np.zeros((2, 1))])

    def places(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        return np.where(keys[at] == wanted, at, len(keys) - 1)

    every, begun = places(np.array([ALL, TEXTS]))
    for low, high, data, offsets in _blocks(texts):
        grams, rows = _grams(data, offsets)
        at = np.stack([places(own) for own in grams])
        # The context of a gram is the next shorter one of the character before.
        contexts = np.full_like(at, begun)
        contexts[0] = every
        contexts[1:, 1:] = np.where(rows[1:] == rows[:-1], at[:-1, :-1], begun)
        logs = []
        for label in (0, 1):
            chance = np.full(len(rows), 1 / 257)
            for order in range(ORDER + 1):
                chance = (counts[label][at[order]] + SMOOTH * chance) / (counts[label][contexts[order]] + SMOOTH)
            logs.append(np.log(chance))
        out[low:high] = np.bincount(rows, logs[1] - logs[0]) / np.bincount(rows)
    return out


def _scored(rows: pa.Table, table: pa.Table) -> pa.Table:
    """Scores of a part's rows; also, of those in the fold, by the counts without it."""
    table = table.sort_by("key")
    keys = table["key"].to_numpy()
    all_, fold = (np.stack([table[name].to_numpy() for name in names]).astype(float).reshape(2, -1) for names in (COUNTS[:2], COUNTS[2:]))
    texts = pc.fill_null(rows["url"], "").combine_chunks()
    score, before = scores(texts, keys, all_), np.full(len(rows), np.nan)
    held = np.flatnonzero(rows["held"].to_numpy())
    before[held] = scores(texts.take(pa.array(held)), keys, all_ - fold)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    score[empty] = before[empty] = 0
    return pa.table({"page_id": rows["page_id"], "url": rows["url"], "held": rows["held"], "score": score, "fold_score": before})


def threshold_of(held: DataFrame) -> float:
    """The score that parts best, from the fold's rows of (accepted, score)."""
    bin_ = F.floor((F.least(F.greatest("score", F.lit(-WIDEST)), F.lit(WIDEST)) + WIDEST) * (BINS / (2 * WIDEST)))
    histogram = held.groupBy("accepted", bin_.cast("int").alias("bin")).count().toPandas()
    masses = np.zeros((2, BINS + 1))
    masses[histogram["accepted"].astype(int), histogram["bin"]] = histogram["count"]
    if not masses.sum(1).all():
        return 0.0
    shares = masses / masses.sum(1, keepdims=True)
    # Errors if everything from a bin on is accepted; the middle of the best bins.
    errors = np.append(0, np.cumsum(shares[1]))[:-1] + 1 - np.append(0, np.cumsum(shares[0]))[:-1]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float((best[0] + best[-1]) / 2 * (2 * WIDEST / BINS) - WIDEST)


def count(known: DataFrame) -> DataFrame:
    """Counts of each gram of rows of (text, accepted, held)."""
    counted = known.mapInArrow(_counted, "key long, " + ", ".join(f"{name} long" for name in COUNTS))
    return counted.groupBy("key").agg(*(F.sum(name).alias(name) for name in COUNTS))


def _parsed(pages: DataFrame) -> DataFrame:
    parsed = pages.select(
        "*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    return parsed.withColumn("ruled", rule_of(F.col("host"), F.col("path")))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url")
    size = pages.agg(F.sum(F.octet_length("url"))).head()[0] or 0
    parts = max(PARTS * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    parsed = _parsed(pages).withColumn("text", F.coalesce("url", F.lit("")))
    in_fold = F.crc32(F.col("text").cast("binary")) % 5 == 0
    rows = parsed.select(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int").alias("part"), "page_id", "url",
        (F.col("ruled").isNotNull() & in_fold).alias("held"),
    )
    known = parsed.where(F.col("ruled").isNotNull())
    counts = count(known.select("text", (F.col("ruled.verdict") == "allow").alias("accepted"), in_fold.alias("held")))
    needed = rows.select("part", F.coalesce("url", F.lit("")).alias("text")).mapInArrow(_needed, "part int, key long").distinct()
    # Sorted and merged at any size, so that what small inputs cost tells what large ones do.
    own = needed.join(counts.hint("merge"), "key").select("part", "key", *COUNTS)
    scored = rows.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(
        _scored, "page_id long, url string, held boolean, score double, fold_score double"
    )
    scored = _parsed(shared_table(scored, "url-scores"))
    threshold = threshold_of(
        scored.where("held").select((F.col("ruled.verdict") == "allow").alias("accepted"), F.col("fold_score").alias("score"))
    )
    learnt = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "ruled.rule", F.coalesce("ruled.verdict", learnt).alias("verdict"), "score"
    )
