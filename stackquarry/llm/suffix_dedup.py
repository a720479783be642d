"""Passages that repeat across documents, by sparse suffix arrays.

A document's words are hashed. Of every LEAST consecutive words, the run of GRAM words with
the least hash is selected (the leftmost of equals), so equal passages select equal places.
Only the suffixes that begin there are kept. They are sorted by the hash of their first
GRAM words over all partitions, and neighbours are compared: a suffix matches if another
document has one with the same beginning. Matches are extended to the left and right: each
passage of LEAST words that selected a matching suffix is hashed and sorted likewise, and
those that another document has too are repeats. The repeats of a document that meet or
overlap make one span, which so reaches as far to both sides as some document agrees.

Sorting cuts ranges by hash, document and place, so a passage of any frequency is spread
over partitions; groups that a cut divides are settled by the ends of the partitions.

Defined results: null, empty and shorter texts have no span. Words are compared as they
are, white space between them is not. Rows with the same id are one document, so what they
share is no repeat. Rows with a null id are left out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackquarry.llm import textbatch
from stackquarry.llm.shared import dropped, shared_table

#: Words of the shortest repeat, and of the beginning that suffixes are sorted by.
LEAST = 50
GRAM = 16

#: States of a compared row: repeated, undecided at an end of its partition, or a witness
#: of a key at such an end.
REPEATED, OPEN, WITNESS = range(3)
COMPARED = "key long, doc_id long, at int, state int"

_STEP = textbatch._STEP
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _runs(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words: a difference of prefix sums."""
    sums = np.append(np.uint64(0), np.cumsum(hashed * _powers(_STEP, len(hashed)), dtype=np.uint64))
    whole = len(hashed) - n + 1
    return textbatch.mixed((sums[n:] - sums[:whole]) * _powers(_BACK, whole))


def _selected(grams: np.ndarray, least: int, gram: int) -> np.ndarray:
    """For each passage of ``least`` words, the place of the least run that lies in it."""
    width = least - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, width)
    out = np.empty(len(views), np.int64)
    for low in range(0, len(views), 65536):
        out[low : low + 65536] = views[low : low + 65536].argmin(1)
    return out + np.arange(len(out))


def _documents(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes of each text that has a word."""
    for low, _, data, offsets in textbatch.slices(*textbatch.bytes_of(texts)):
        starts, ends, rows = textbatch.words(data, offsets)
        if len(starts):
            hashed = textbatch.hashes(data, starts, ends)
            cuts = np.flatnonzero(np.diff(rows)) + 1
            for row, own in zip(rows[np.append(0, cuts)].tolist(), np.split(hashed, cuts)):
                yield low + row, own


def _batch(keys: list, ids: list, places: list) -> pa.RecordBatch:
    def whole(parts: list, kind) -> np.ndarray:
        return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)

    columns = [whole(keys, np.uint64).view(np.int64), whole(ids, np.int64), whole(places, np.int32)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "doc_id", "at"])


def _suffixes(least: int, gram: int):
    """The selected places of each text, with the hash of their first words."""

    def suffixes(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            ids = table.column("doc_id").to_numpy()
            keys, owners, places = [], [], []
            for row, hashed in _documents(table.column("text")):
                if len(hashed) >= least:
                    grams = _runs(hashed, gram)
                    at = np.unique(_selected(grams, least, gram))
                    keys.append(grams[at])
                    owners.append(np.full(len(at), ids[row]))
                    places.append(at)
            yield _batch(keys, owners, places)

    return suffixes


def _passages(least: int, gram: int):
    """The passages of each text that selected one of its matching suffixes."""

    def passages(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            ids = table.column("doc_id").to_numpy()
            matching = table.column("places")
            keys, owners, places, n = [], [], [], 0
            for row, hashed in _documents(table.column("text")):
                if len(hashed) < least:
                    continue
                chosen = np.zeros(len(hashed), bool)
                wanted = matching[row].values.to_numpy()
                chosen[wanted[wanted < len(hashed)]] = True
                at = np.flatnonzero(chosen[_selected(_runs(hashed, gram), least, gram)])
                keys.append(_runs(hashed, least)[at])
                owners.append(np.full(len(at), ids[row]))
                places.append(at)
                n += len(at)
                if n > 200_000:
                    yield _batch(keys, owners, places)
                    keys, owners, places, n = [], [], [], 0
            yield _batch(keys, owners, places)

    return passages


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the sorted rows of a partition with their neighbours. Held back is only the
    last run of rows with one key and document, until what follows it is known."""
    held = np.empty((0, 3), np.int64)
    before = None  # key of the run before the held one
    first, last = None, None  # (key, its least and greatest document) at the two ends

    def out(rows: np.ndarray, states: np.ndarray) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.int32)
        columns = [pa.array(rows[:, k].astype(kind)) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(states.astype(np.int32))], names=["key", "doc_id", "at", "state"])

    def settled(rows: np.ndarray, previous, following, opening: bool) -> pa.RecordBatch:
        """Rows of whole runs, given the keys of the runs around them."""
        new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))
        keys = rows[new, 0]
        with_next = np.append(keys[1:] == keys[:-1], following is not None and keys[-1] == following)
        with_last = np.append(previous is not None and keys[0] == previous, keys[1:] == keys[:-1])
        states = np.where(with_next | with_last, REPEATED, -1)
        if opening and states[0] < 0:
            states[0] = OPEN
        if following is None and states[-1] < 0:
            states[-1] = OPEN
        states = states[np.cumsum(new) - 1]
        return out(rows[states >= 0], states[states >= 0])

    opening = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([column.to_numpy().astype(np.int64) for column in batch.columns[:3]], axis=1)
        for key, docs in ((rows[0, 0], rows[rows[:, 0] == rows[0, 0], 1]), (rows[-1, 0], rows[rows[:, 0] == rows[-1, 0], 1])):
            low, high = docs.min(), docs.max()
            if first is None or first[0] == key:
                first = (key, min(low, first[1]) if first else low, max(high, first[2]) if first else high)
            last = (key, min(low, last[1]), max(high, last[2])) if last and last[0] == key else (key, low, high)
        rows = np.concatenate([held, rows])
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        if not len(cuts):
            held = rows
            continue
        done, held = rows[: cuts[-1]], rows[cuts[-1] :]
        yield settled(done, before, held[0, 0], opening)
        before, opening = done[-1, 0], False
    if len(held):
        yield settled(held, before, None, opening)
        ends = [(key, doc, -1) for key, *docs in (first, last) for doc in docs]
        yield out(np.array(ends, np.int64), np.full(len(ends), WITNESS))


def _shared_rows(rows: DataFrame, name: str) -> DataFrame:
    """The rows (key, doc_id, at) whose key some other document has too."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "at"]
    compared = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_compare, COMPARED)
    compared = shared_table(compared, name)
    open_ = compared.where(F.col("state") == OPEN).select(*order)
    # A few rows for each partition: those at its ends.
    witness = compared.where(F.col("state") == WITNESS).select("key", F.col("doc_id").alias("other")).distinct()
    late = open_.join(witness, "key").where(F.col("other") != F.col("doc_id")).select(*order).distinct()
    return compared.where(F.col("state") == REPEATED).select(*order).unionByName(late)


def repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) and n_words of every span of at least
    ``least`` words that other documents repeat. Documents without one have no row."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    schema = "key long, doc_id long, at int"
    suffixes = shared_table(docs.mapInArrow(_suffixes(least, gram), schema), "suffixes")
    matching = _shared_rows(suffixes, "suffix-neighbours").groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    matching = shared_table(matching, "suffix-matches")
    dropped(suffixes)
    passages = docs.join(matching, "doc_id").select("doc_id", "text", "places").mapInArrow(_passages(least, gram), schema)
    passages = shared_table(passages, "passages")
    found = _shared_rows(passages, "passage-neighbours").select("doc_id", "at").distinct()
    places = Window.partitionBy("doc_id").orderBy("at")
    opens = F.coalesce(F.col("at") > F.lag("at").over(places) + least, F.lit(True))
    spans = found.select("doc_id", "at", opens.cast("int").alias("opens"))
    spans = spans.select("doc_id", "at", F.sum("opens").over(places).alias("span"))
    return spans.groupBy("doc_id", "span").agg(
        F.min("at").cast("bigint").alias("start_word"), (F.max("at") + least).cast("bigint").alias("end_word")
    ).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
