"""Quality of documents from a linear-chain CRF over their lines.

Every line that has a word is an element of its document's chain and gets the label good
or bad. Its features count characters and words of the line itself and of the lines
before and after it. The field is trained on a bounded sample of labelled documents, each
line taking its document's label, and a document's score is the mean of its lines'
forward-backward probabilities of good, weighted by their bytes.

Defined results: a null or empty text, or one without words, has no line; its score is 0.
Rows with equal texts have equal scores. With no labelled document (or only one label
among them) every document with a word scores the share of label 1, 0.5 without any.
Columns other than doc_id and text are never read; in ``kept`` they stay with their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackquarry.llm import crf, textbatch

#: Bounds of the training sample: labelled documents, by the hash of their id, and lines
#: of one document, from its start.
TRAIN_DOCUMENTS = 2000
TRAIN_LINES = 60
#: A document is predicted good from this score.
THRESHOLD = 0.3

UPPER, LOWER, DIGIT, MARK, HIGH = range(5)
CLASS = np.full(256, MARK, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER, DIGIT, HIGH
CLASS[textbatch.SPACE] = 255
#: Marks of running prose.
CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 254

OWN = 13


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, row and bytes of each line with a word, in order."""
    starts, ends, rows = textbatch.words(data, offsets)
    if not len(starts):
        return np.empty((0, 3 * OWN + 3)), np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = np.cumsum(data == 10)
    line = breaks[starts]
    new = np.append(True, (line[1:] != line[:-1]) | (rows[1:] != rows[:-1]))
    firsts = np.flatnonzero(new)
    last = np.append(firsts[1:], len(starts)) - 1
    low, high = starts[firsts], ends[last]
    size = (high - low).astype(float)
    n_words = (last - firsts + 1).astype(float)
    kinds = CLASS[data]

    def share(mask: np.ndarray, whole: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask, dtype=np.int32))
        return (sums[high] - sums[low]) / whole

    def words_share(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int32), firsts) / n_words

    hashed = textbatch.hashes(data, starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (rows[1:] == rows[:-1])
    lengths = ends - starts
    final = data[ends - 1]
    marked = (kinds[ends - 1] == MARK) & (lengths > 1)
    alone = (lengths == 1) & (kinds[starts] == MARK)
    text = np.add.reduceat(hashed * (np.arange(len(hashed)) - firsts[np.cumsum(new) - 1] + 1).astype(np.uint64), firsts)
    row = rows[firsts]
    _, place, count = np.unique(np.stack([row.astype(np.uint64), text]), axis=1, return_inverse=True, return_counts=True)
    ended = (data[high - 1] == 46) | (data[high - 1] == 33) | (data[high - 1] == 63)
    own = np.stack(
        [
            share(kinds == UPPER, size),
            share(kinds == MARK, size) * 3,
            share(kinds == DIGIT, size) * 2,
            share(kinds == 254, size) * 3,
            words_share(again),
            words_share(marked),
            words_share(alone),
            words_share(final == 33),
            words_share((data[starts] >= 65) & (data[starts] <= 90)),
            np.minimum(size / n_words / 10, 2),
            np.log1p(n_words) / 5,
            (count[place.ravel()] > 1).astype(float),
            ended.astype(float),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = row[1:] == row[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    opens, closes = np.append(True, ~same), np.append(~same, True)
    edges = np.stack([np.ones(len(own)), opens, closes], axis=1)
    return np.hstack([own, before, after, edges]), row, size.astype(np.int64)


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, held_out: bool = True) -> crf.Chain | float:
    """A field trained on a sample of the labelled documents, without the held-out fold;
    or the share of label 1 where the sample holds one label only."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("quality").cast("int").alias("label"))
    if held_out:
        known = known.where(_fold(F.col("id")) != 0)
    known = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS)
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(known), "id")

    @textbatch.lean
    def lines(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            marks = table.column("label").to_numpy(zero_copy_only=False)
            ids = table.column("id").to_numpy(zero_copy_only=False)
            for low, _, data, offsets in textbatch.slices(*textbatch.bytes_of(table.column("text"))):
                features, rows, _ = line_features(data, offsets)
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                kept = nth < TRAIN_LINES
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[low + rows[kept]], pa.int64()),
                        pa.array(nth[kept], pa.int32()),
                        pa.array(marks[low + rows[kept]], pa.int32()),
                        pa.array(features[kept].astype(np.float32).tolist(), pa.list_(pa.float32())),
                    ],
                    names=["id", "nth", "label", "features"],
                )

    got = chosen.select("id", "label", "text").mapInArrow(lines, "id long, nth int, label int, features array<float>")
    got = got.toPandas().sort_values(["id", "nth"], kind="stable")
    if got["label"].nunique() < 2:
        return float(got["label"].mean()) if len(got) else 0.5
    starts = np.flatnonzero(got["nth"].to_numpy() == 0)
    lengths = np.diff(np.append(starts, len(got)))
    features = np.stack(got["features"].to_numpy()).astype(float)
    return crf.train(features, got["label"].to_numpy(), lengths, 2)


def batch_scores(texts: pa.Array, model: crf.Chain | float) -> np.ndarray:
    """The score of each text."""
    scores = np.zeros(len(texts))
    for low, high, data, offsets in textbatch.slices(*textbatch.bytes_of(texts)):
        features, rows, sizes = line_features(data, offsets)
        if not len(rows):
            continue
        if isinstance(model, float):
            good = np.full(len(rows), model)
        else:
            lengths = np.bincount(rows, minlength=high - low)
            good = crf.marginals(model, model.scores(features), lengths[lengths > 0])[:, 1]
        weight = np.bincount(rows, sizes, high - low)
        total = np.bincount(rows, sizes * good, high - low)
        scores[low:high] = np.divide(total, weight, out=np.zeros(high - low), where=weight > 0)
    return np.clip(scores, 0, 1)


def scorer(model: crf.Chain | float):
    """A function column over Arrow arrays: text to score. (As a pandas function it would
    hold every text of a batch three times: as Arrow, as strings and as Arrow again.)"""

    @F.arrow_udf("double")
    @textbatch.lean
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(batch_scores(texts, model))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    model = train(docs, labels)

    @textbatch.lean
    def scored(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            yield pa.RecordBatch.from_arrays(
                [table.column(0), pa.array(batch_scores(table.column(1), model))], names=["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select(
        "doc_id",
        (_fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    model = train(docs, labels)
    return docs.where(scorer(model)(F.col("text")) >= THRESHOLD)
