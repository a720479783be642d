"""Benchmark passages in documents: a prefix-filtered set join of windows and texts.

A window is ``size`` consecutive words of an item; an item of fewer words, but not none,
is one window. As sets of shingles (runs of up to SHINGLE words), a window occurs in a text
only where all its shingles do, so any one of them is a sufficient prefix of its sorted
set: shingles are ordered by how often they occur in the documents, and only the rarest of
each window is looked up. Where it stands in a text it fixes the one place of the window;
length and position bound that place to the text, and the words there are compared.

Two passes over the documents: one counts the items' shingles, one finds and verifies. While
the items' text is small (SMALL_BYTES, checked) both run inside the tasks against arrays, and
no document is shuffled. Larger sets of items stay a distributed table: a bitmap of bounded
size lets through the shingles that may matter, and these meet the windows in a join.

Defined results: null, empty texts and texts without words have no words and no hit; so have
items. Equal items and repeated rows count as often as they come; item ids are listed once,
null ids never, though their windows hit. An empty table of items leaves every document
clean. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackquarry.llm import textbatch
from stackquarry.llm.shared import shared_table

#: Words of a window, and of a shingle.
WINDOW = 10
SHINGLE = 3
#: Bytes of items' text up to which windows are sent to the tasks.
SMALL_BYTES = 4 << 20
#: Bits of the bitmap of shingles of a larger set of items.
BITS = 1 << 26

SPANS = "array<struct<start: long, end: long>>"
FOUND = f"n_words long, n_hit long, items array<string>, spans {SPANS}"

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of texts, in the order of the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _LETTER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.hashes = textbatch.hashes(data, self.starts, self.ends, textbatch.LOWER_HASH)
        self._flat: tuple[bytes, np.ndarray] | None = None
        self._chars: np.ndarray | None = None

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first word, and hash, of each run of words within a text."""
        n = max(len(self.rows) - length + 1, 0)
        at = np.flatnonzero(self.rows[:n] == self.rows[length - 1 : length - 1 + n])
        return at, self.run_hashes(at, np.full(len(at), length))

    def run_hashes(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(int(lengths.max(initial=0))):
            more = lengths > k
            out[more] = out[more] * _STEP + self.hashes[at[more] + k]
        return textbatch.mixed(out + lengths.astype(np.uint64))

    def text(self, first: int, end: int) -> bytes:
        """Words from ``first`` up to ``end``, lower-cased, joined by a space."""
        if self._flat is None:
            sizes = self.ends - self.starts
            begins = np.cumsum(sizes + 1) - sizes - 1
            flat = np.full(int((sizes + 1).sum()), 32, np.uint8)
            places = np.flatnonzero(_LETTER[self.data])
            flat[places + np.repeat(begins - self.starts, sizes)] = _LOWER[self.data[places]]
            self._flat = flat.tobytes(), np.append(begins, len(flat))
        flat, begins = self._flat
        return flat[begins[first] : begins[end] - 1]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points of its text before each byte, given with the byte's row."""
        if self._chars is None:
            self._chars = np.append(0, np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64))
        return self._chars[at]

    def spans(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and end (code points) of each run of hit words."""
        opens, closes = hit.copy(), hit.copy()
        same = self.rows[1:] == self.rows[:-1]
        opens[1:] &= ~(hit[:-1] & same)
        closes[:-1] &= ~(hit[1:] & same)
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        rows = self.rows[first]
        base = self.chars(self.offsets[rows])
        return rows, self.chars(self.starts[first]) - base, self.chars(self.ends[last]) - base


class Index:
    """The windows of a small set of items, and the shingle that each is looked up by."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        texts = pa.array([text for _, text in items], pa.large_string())
        words = Words(*textbatch.bytes_of(texts))
        bounds = np.searchsorted(words.rows, np.arange(len(items) + 1))
        windows: dict[bytes, int] = {}
        holders: list[set[str]] = []
        self.hashes: list[np.ndarray] = []
        lengths = []
        for k, (name, _) in enumerate(items):
            low, high = int(bounds[k]), int(bounds[k + 1])
            length = min(size, high - low)
            for first in range(low, high - length + 1) if length else ():
                text = words.text(first, first + length)
                nth = windows.setdefault(text, len(windows))
                if nth == len(holders):
                    holders.append(set())
                    lengths.append(length)
                    own = np.arange(first, first + length - min(SHINGLE, length) + 1)
                    self.hashes.append(words.run_hashes(own, np.full(len(own), min(SHINGLE, length))))
                if name is not None:
                    holders[nth].add(name)
        self.texts, self.items = list(windows), [sorted(own) for own in holders]
        self.lengths = np.array(lengths, np.int64)
        self.shingles = np.unique(np.concatenate([*self.hashes, np.empty(0, np.uint64)]))
        self.widths = sorted({min(SHINGLE, length) for length in lengths})
        self.keys = np.empty(0, np.uint64)

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle: fewest occurrences, then least hash."""
        keys, shifts = [], []
        for own in self.hashes:
            places = np.searchsorted(self.shingles, own)
            best = np.lexsort((own, counts[places]))[0]
            keys.append(own[best])
            shifts.append(best)
        keys = np.array(keys, np.uint64)
        by = np.argsort(keys, kind="stable")
        self.keys, firsts = np.unique(keys[by], return_index=True)
        self.bounds = np.append(firsts, len(by))
        self.by, self.shifts = by, np.array(shifts, np.int64)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each occurrence, verified."""
        starts, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for width in self.widths if len(self.keys) else ():
            at, hashes = words.runs(width)
            nth = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            live = self.keys[nth] == hashes
            at, nth = at[live], nth[live]
            counts = self.bounds[nth + 1] - self.bounds[nth]
            many = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            window = self.by[np.repeat(self.bounds[nth], counts) + many]
            start = np.repeat(at, counts) - self.shifts[window]
            end = start + self.lengths[window]
            row = words.rows[np.repeat(at, counts)]
            fits = (start >= 0) & (end <= len(words.rows)) & (np.minimum(self.lengths[window], SHINGLE) == width)
            fits[fits] &= (words.rows[start[fits]] == row[fits]) & (words.rows[end[fits] - 1] == row[fits])
            starts.append(start[fits])
            found.append(window[fits])
        start, window = np.concatenate(starts), np.concatenate(found)
        same = [
            words.text(a, a + n) == self.texts[w]
            for a, n, w in zip(start.tolist(), self.lengths[window].tolist(), window.tolist())
        ]
        same = np.array(same, bool)
        return start[same], window[same]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for low, high, data, offsets in textbatch.slices(*textbatch.bytes_of(column)):
        yield low, high, Words(data, offsets)


def _hits(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    depth = np.zeros(len(words.rows) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def _counted(docs: DataFrame, shingles: np.ndarray, widths: list[int]) -> np.ndarray:
    """How often each of the sorted shingles occurs in all documents."""

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shingles), np.int64)
        for table in tables:
            for _, _, words in _slices(table.column(0)):
                for width in widths:
                    hashes = words.runs(width)[1]
                    nth = np.minimum(np.searchsorted(shingles, hashes), len(shingles) - 1)
                    sums += np.bincount(nth[shingles[nth] == hashes], minlength=len(shingles))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["nth", "n"])

    out = np.zeros(len(shingles), np.int64)
    if len(shingles):
        counts = docs.select("text").mapInArrow(count, "nth long, n long")
        got = counts.groupBy("nth").agg(F.sum("n").alias("n")).toPandas()
        out[got["nth"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _small(docs: DataFrame, items: list[tuple[str | None, str]], size: int) -> DataFrame:
    index = Index(items, size)
    index.order(_counted(docs, index.shingles, index.widths))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def find(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            n_words, n_hit, items, spans = [], [], [], []
            for low, high, words in _slices(table.column("text")):
                n = high - low
                start, window = index.occurrences(words)
                hit = _hits(words, start, start + index.lengths[window])
                n_words += np.bincount(words.rows, minlength=n).tolist()
                n_hit += np.bincount(words.rows[hit], minlength=n).tolist()
                held: list[set[str]] = [set() for _ in range(n)]
                pairs = set(zip(words.rows[start].tolist(), window.tolist()))
                for row, nth in pairs:
                    held[row].update(index.items[nth])
                own: list[list[dict]] = [[] for _ in range(n)]
                for row, a, b in zip(*(part.tolist() for part in words.spans(hit))):
                    own[row].append({"start": a, "end": b})
                items += [sorted(some) for some in held]
                spans += own
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(span)),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {id_type}, {FOUND}")


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item, window, its length and the hashes of its shingles in order."""

    def cut(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            names = table.column("item").to_pylist()
            for low, high, words in _slices(table.column("text")):
                out = []
                bounds = np.searchsorted(words.rows, np.arange(high - low + 1)).tolist()
                for row, (first, end) in enumerate(zip(bounds, bounds[1:])):
                    length = min(size, end - first)
                    width = min(SHINGLE, length)
                    for at in range(first, end - length + 1) if length else ():
                        own = np.arange(at, at + length - width + 1)
                        hashes = words.run_hashes(own, np.full(len(own), width)).view(np.int64)
                        out.append((names[low + row], words.text(at, at + length).decode(), length, hashes.tolist()))
                columns = list(zip(*out)) if out else [()] * 4
                kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "window", "length", "hashes"]
                )

    return benchmark.mapInArrow(cut, "item string, window string, length long, hashes array<long>")


def _bitmap(hashes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test that passes each hash of the table; at most BITS / 64 rows are collected."""
    slot = F.pmod("hash", F.lit(BITS))
    words = hashes.select(
        F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)

    def test(some: np.ndarray) -> np.ndarray:
        slots = some & np.uint64(BITS - 1)
        return (table[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) > 0

    return test


def _large(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    windows = shared_table(_windows(benchmark, size), "windows")
    held = windows.where("item is not null").select("window", "item").distinct()
    own = windows.groupBy("window").agg(F.first("length").alias("length"), F.first("hashes").alias("hashes"))
    own = own.select("window", "length", F.posexplode("hashes").alias("shift", "hash"))
    widths = [int(row[0]) for row in windows.select(F.least("length", F.lit(SHINGLE))).distinct().collect()]
    known = _bitmap(own.select("hash"))

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for _, _, words in _slices(table.column(0)):
                every = [words.runs(width)[1] for width in widths]
                hashes, n = np.unique(np.concatenate([*every, np.empty(0, np.uint64)]), return_counts=True)
                live = known(hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[live].view(np.int64)), pa.array(n[live])], names=["hash", "n"]
                )

    counts = docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rare = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "shift", "length")).alias("rare")
    prefixes = own.join(counts, "hash", "left").groupBy("window").agg(rare).select("window", "rare.*").drop("n")
    prefixes = shared_table(prefixes, "prefixes")
    wanted = _bitmap(prefixes.select("hash"))
    around = size - 1

    def near(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            texts = table.column("digest").to_pylist()
            for low, high, words in _slices(table.column("text")):
                bounds = np.searchsorted(words.rows, np.arange(high - low + 1))
                out = []
                for width in widths:
                    at, hashes = words.runs(width)
                    live = wanted(hashes)
                    for p, h in zip(at[live].tolist(), hashes[live].view(np.int64).tolist()):
                        row = int(words.rows[p])
                        first, end = max(p - around, int(bounds[row])), min(p + size, int(bounds[row + 1]))
                        base = words.chars(words.offsets[row])
                        out.append((
                            texts[low + row], h, p - int(bounds[row]), p - first, words.text(first, end).decode(),
                            (words.chars(words.starts[first:end]) - base).tolist(),
                            (words.chars(words.ends[first:end]) - base).tolist(),
                        ))
                columns = list(zip(*out)) if out else [()] * 7
                kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), *[pa.list_(pa.int64())] * 2]
                names = ["digest", "hash", "place", "before", "around", "begins", "ends"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    # Equal texts have equal hits: these are found once for each digest and joined back.
    texts = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    places = "digest string, hash long, place long, before long, around string, begins array<long>, ends array<long>"
    first = F.col("before") - F.col("shift")
    part = F.split("around", " ")
    fits = (first >= 0) & (first + F.col("length") <= F.size(part))
    met = texts.select("digest", "text").mapInArrow(near, places).distinct().join(prefixes, "hash").where(fits)
    whole = F.array_join(F.slice(part, (first + 1).cast("int"), F.col("length").cast("int")), " ")
    hits = shared_table(
        met.where(whole == F.col("window")).select(
            "digest", "window", (F.col("place") - F.col("shift")).alias("low"),
            (F.col("place") - F.col("shift") + F.col("length")).alias("high"),
            F.get("begins", first.cast("int")).alias("start"),
            F.get("ends", (first + F.col("length") - 1).cast("int")).alias("end"),
        ).distinct(),
        "hits",
    )
    # Runs of overlapping or touching windows: a new one begins beyond all ends before it.
    before = Window.partitionBy("digest").orderBy("low", "high")
    fresh = F.col("low") > F.coalesce(F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = hits.groupBy("digest", "low", "high").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.withColumn("fresh", fresh.cast("long"))
    runs = runs.withColumn("run", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("digest", "run").agg(
        (F.max("high") - F.min("low")).alias("n"), F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span")
    )
    sets = runs.groupBy("digest").agg(F.sum("n").alias("n_hit"), F.array_sort(F.collect_list("span")).alias("spans"))
    named = hits.select("digest", "window").distinct().join(held, "window").groupBy("digest").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )

    def sized(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            n = [0]
            for low, high, words in _slices(table.column("text")):
                n += np.bincount(words.rows, minlength=high - low).tolist()
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id"), table.column("digest"), pa.array(n[1:], pa.int64())],
                names=["doc_id", "digest", "n_words"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = texts.mapInArrow(sized, f"doc_id {id_type}, digest string, n_words long")
    return every.join(sets, "digest", "left").join(named, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, small: int = SMALL_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words inside occurrences of windows), items (ids whose windows
    occur, sorted) and spans (runs of hit words, code points) of each row of ``docs``."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(16)), F.lit(0)).alias("n")).first()["n"]
    if total > small:
        return _large(docs.select("doc_id", "text"), items, size)
    return _small(docs.select("doc_id", "text"), [(row["item"], row["text"]) for row in items.collect()], size)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts of words, hits and items, and the digest of the items, of each row."""
    return contamination(docs, benchmark).select(
        F.col("doc_id").cast("bigint"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

