"""Secrets in texts: fixed patterns, and a linear-chain CRF over words.

The patterns' matches always stay. The field tags words as begin, inside or outside of a
secret by their shape, the words beside them and features of the whole text, and its best
path by Viterbi adds spans that no pattern match overlaps. It is trained on the whole texts of
a bounded sample of documents (of very long ones, on windows from all over them), whose words
are labelled by the patterns' matches; it sees shapes and neighbours, not the patterns, and so
goes beyond them.

A chain holds all words of a text. A word whose own scores are so clear that no neighbour's
label can take it from the outside is outside on the best path, so paths are only sought
between such words; the result is that of the whole chain. A word is live if it has a digit,
or a character of names and values (see LIVE), or is long; their share is a feature.

Defined results: a null or empty text has no span. The field adds none under LEAST_ADDED. Positions count code points. Rows with
equal texts have equal spans. If the sample has no match, the field adds nothing. Extra
columns are ignored; ``redacted`` keeps them.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackquarry.llm import crf, textbatch

#: Kinds of base spans, in their order, and the pattern and least length of each.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ["assign", "access", "hex", "crf"]
NAMES = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]

#: Characters that make a word live, besides digits; and the length that does.
LIVE = "=:_+/"
LONG = 24
#: Bounds of the training sample. So many documents, by the hash of their id, are looked at.
#: All of them with a labelled word train, and so many of the others, which weigh for the rest.
TRAIN_DOCUMENTS = 2000
TRAIN_PLAIN = 100
#: Words of one document that train. Up to so many, a text is one whole chain.
TRAIN_WORDS = 400
#: Words of a window; a longer text gives windows, half of them with labels if there are.
TRAIN_WINDOW = 50
#: Weight of the penalty on squared weights (labelled words are rare), and the share of its
#: loss that ten rounds of training must take off.
TRAIN_PENALTY = 1e-7
TRAIN_GAIN = 0.01
#: Code points of a span that the field may add, at least.
LEAST_ADDED = 8
#: Bytes of text worked on at a time.
SLICE_BYTES = 1 << 19
#: What a span becomes in redacted texts.
MARK = "[SECRET]"

OUTSIDE, BEGIN, INSIDE = range(3)
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

_LIVE_BYTE = np.zeros(256, bool)
_LIVE_BYTE[48:58] = True
_LIVE_BYTE[[ord(c) for c in LIVE]] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[48:58] = _HEX_BYTE[97:103] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NAME = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_TRIM = "\"'`()[]{}<>,;.!?"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return _ordered(found)


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows that may hold a base span: all that do, and a few more."""
    inside = _HEX_BYTE[data]
    # Runs end with their text, also where the next one goes on in hex.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    places = starts[np.flatnonzero(closes) - starts + 1 >= LEAST_HEX].tolist()
    lowered = data.tobytes().translate(_LOWER)
    for needle, heap in [(b"AKIA", data.tobytes()), *((name, lowered) for name in NAMES)]:
        at = heap.find(needle)
        while at >= 0:
            places.append(at)
            at = heap.find(needle, at + 1)
    return set((np.searchsorted(offsets, np.array(places, np.int64), "right") - 1).tolist())


def _shape(word: str) -> list[float]:
    core = word.strip(_TRIM)
    n = len(core)
    digits = sum(map(str.isdigit, core))
    upper, lower = sum(map(str.isupper, core)), sum(map(str.islower, core))
    kinds = ["d" if c.isdigit() else "a" if c.isalpha() else "p" for c in core]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    marks = n - digits - upper - lower
    return [
        n >= 8, n >= 12, n >= 16, n >= 20, n >= 32,
        digits > 0 and digits + marks == n, digits > 0 and upper + lower > 0, upper > 0 and lower > 0,
        digits / max(n, 1), turns / max(n, 1), len(set(core)) / max(n, 1), marks / max(n, 1),
        word in ("=", ":", "=>", ":="), "=" in word or ":" in word, "@" in core or core.count(".") > 2,
        word[:1] in "\"'`", bool(_NAME.search(word)), core[:4].isupper() and digits > 0,
    ]


#: Width of a shape, and its place that tells names of secrets.
SHAPES, NAMED = len(_shape("")), 16

#: What each code point below WIDE is, as bits.
WIDE = 1 << 16
_DIGIT, _ALPHA, _UPPER, _LOWER_CASE, _TITLE, _TRIMMED = (1 << k for k in range(6))
_KIND = np.array(
    [
        c.isdigit() * _DIGIT | c.isalpha() * _ALPHA | c.isupper() * _UPPER | c.islower() * _LOWER_CASE
        | (c.istitle() and not c.isupper()) * _TITLE | (c in _TRIM) * _TRIMMED
        for c in map(chr, range(WIDE))
    ],
    np.uint8,
)


def shapes_of(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``_shape`` of many words, each a range of the code points."""
    sizes = ends - starts
    flat = points[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    word = np.repeat(np.arange(len(sizes)), sizes)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - firsts[word]
    kind = _KIND[np.minimum(flat, WIDE - 1)]
    inner = kind & _TRIMMED == 0
    low = np.minimum.reduceat(np.where(inner, place, len(flat)), firsts)
    high = np.maximum.reduceat(np.where(inner, place, -1), firsts)
    core = (place >= low[word]) & (place <= high[word])

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word[mask], minlength=len(sizes))

    n = count(core)
    digits, upper, lower = (count(core & (kind & bit > 0)) for bit in (_DIGIT, _UPPER, _LOWER_CASE))
    marks = n - digits - upper - lower
    group = np.where(kind & _DIGIT > 0, 2, np.where(kind & _ALPHA > 0, 1, 0))
    beside = core[1:] & core[:-1] & (word[1:] == word[:-1])
    turns = np.bincount(word[1:][beside & (group[1:] != group[:-1])], minlength=len(sizes))
    keys = np.unique((word[core].astype(np.int64) << 21) | flat[core])
    distinct = np.bincount(keys >> 21, minlength=len(sizes))
    head = core & (place < low[word] + 4)
    cased = count(head & (kind & (_UPPER | _LOWER_CASE | _TITLE) > 0))
    signs = count((flat == ord("=")) | (flat == ord(":")))
    lone = (signs == sizes) & ((sizes == 1) | (sizes == 2) & (flat[firsts] == ord(":")) & (flat[np.minimum(firsts + 1, len(flat) - 1)] == ord("=")))
    arrow = (sizes == 2) & (flat[firsts] == ord("=")) & (flat[np.minimum(firsts + 1, len(flat) - 1)] == ord(">"))
    some = np.maximum(n, 1)
    out = np.stack(
        [
            n >= 8, n >= 12, n >= 16, n >= 20, n >= 32,
            (digits > 0) & (digits + marks == n), (digits > 0) & (upper + lower > 0), (upper > 0) & (lower > 0),
            digits / some, turns / some, distinct / some, marks / some,
            lone | arrow, signs > 0, (count(core & (flat == ord("@"))) > 0) | (count(core & (flat == ord("."))) > 2),
            np.isin(flat[firsts], [ord(c) for c in "\"'`"]), np.zeros(len(sizes)),
            (cased > 0) & (count(head & (kind & _UPPER > 0)) == cased) & (digits > 0),
        ],
        axis=1,
    ).astype(float)
    # One scan over all words, apart by a line feed, finds the names of secrets.
    apart = np.full(len(flat) + len(sizes), 10, np.uint32)
    at = np.arange(len(flat)) + word
    apart[at] = flat
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    for match in _NAME.finditer(apart.tobytes().decode("utf-32-le", "surrogatepass")):
        out[owner[match.start()], NAMED] = 1
    # Characters beyond the table are rare: their words are looked at one by one.
    for k in np.unique(word[flat >= WIDE]).tolist():
        out[k] = _shape(flat[firsts[k] : firsts[k] + sizes[k]].tobytes().decode("utf-32-le", "surrogatepass"))
    return out


class Features:
    """Features of words, as rows of a table of shapes: its own, those of the words before
    and after, and whether the one before these names a secret; then those of the whole
    text. Row 0 of the table has no shape. As a matrix it is multiplied from both sides."""

    def __init__(self, shapes: np.ndarray, places: list[np.ndarray], whole: np.ndarray):
        self.tables = [shapes, shapes, shapes, shapes[:, NAMED : NAMED + 1]]
        self.places, self.whole = places, whole
        self.cuts = np.cumsum([table.shape[1] for table in self.tables])
        self.shape = len(whole), int(self.cuts[-1]) + whole.shape[1]

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        *parts, last = np.split(weights, self.cuts)
        out = np.einsum("nk,kl->nl", self.whole, last)
        for table, place, part in zip(self.tables, self.places, parts):
            out += (table @ part)[place]
        return out

    @property
    def T(self) -> "_Turned":
        return _Turned(self)


class _Turned:
    def __init__(self, features: Features):
        self.features = features

    def __matmul__(self, values: np.ndarray) -> np.ndarray:
        own = self.features
        out = []
        for table, place in zip(own.tables, own.places):
            sums = [np.bincount(place, column, len(table)) for column in values.T]
            out.append(table.T @ np.stack(sums, axis=1))
        return np.vstack([*out, np.einsum("nk,nl->kl", own.whole, values)])


class Chains:
    """The chains of one slice of texts: all words of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, texts: list[str]):
        starts, ends, rows = textbatch.words(data, offsets)
        sums = np.append(0, np.cumsum(_LIVE_BYTE[data], dtype=np.int64))
        live = (sums[ends] > sums[starts]) | (ends - starts >= LONG)
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
        first = chars[offsets[rows]]
        self.texts, self.rows = texts, rows
        self.starts, self.ends = chars[starts] - first, chars[ends] - first
        self.lengths = np.bincount(rows, minlength=len(texts))
        n_live = np.bincount(rows[live], minlength=len(texts))
        self.density = n_live / np.maximum(self.lengths, 1)
        self.lengths = self.lengths[self.lengths > 0]
        # Each distinct word's shape is found once.
        hashes = textbatch.hashes(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
        _, some, place = np.unique(hashes, return_index=True, return_inverse=True)
        shapes = np.zeros((len(some) + 1, SHAPES))
        if len(some):
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            shapes[1:] = shapes_of(points, chars[starts[some]], chars[ends[some]])
        own = place + 1
        before, after, earlier = (np.zeros(len(own), np.int64) for _ in range(3))
        same, both = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
        before[1:][same], after[:-1][same], earlier[2:][both] = own[:-1][same], own[1:][same], own[:-2][both]
        self.named = np.zeros(len(texts))
        np.maximum.at(self.named, rows, shapes[own, NAMED])
        whole = np.stack([np.ones(len(own)), self.density[rows], self.named[rows]], axis=1)
        self.shapes = shapes
        self.features = Features(shapes, [own, before, after, earlier], whole)

    def word(self, at: int) -> str:
        return self.texts[self.rows[at]][self.starts[at] : self.ends[at]]


def _labels(chains: Chains, spans: dict[int, list[tuple[str, int, int]]]) -> np.ndarray:
    """Begin for the first word that a row's base span touches, inside for its others."""
    labels = np.zeros(len(chains.rows), np.int64)
    for row, found in spans.items():
        low, high = np.searchsorted(chains.rows, [row, row + 1])
        starts, ends = chains.starts[low:high], chains.ends[low:high]
        for _, start, end in found:
            a, b = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
            own = np.where(starts[a:b] > start, INSIDE, BEGIN)
            labels[low + a : low + b] = np.maximum(labels[low + a : low + b], own)
    return labels


def _windows(labels: np.ndarray) -> list[tuple[int, int]]:
    """The parts of a text that train: all of a short one, else windows from all over it,
    up to half of them from those with labels."""
    n = len(labels)
    if n <= TRAIN_WORDS:
        return [(0, n)]
    starts = np.arange(0, n, TRAIN_WINDOW)
    marked = np.add.reduceat(labels > 0, starts) > 0
    most = TRAIN_WORDS // TRAIN_WINDOW

    def spread(some: np.ndarray, k: int) -> np.ndarray:
        return some[(np.arange(min(k, len(some))) * len(some)) // max(min(k, len(some)), 1)]

    chosen = spread(starts[marked], most // 2)
    chosen = np.sort(np.append(chosen, spread(starts[~marked], most - len(chosen))))
    return [(int(low), int(min(low + TRAIN_WINDOW, n))) for low in chosen]


def viterbi(field: crf.Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crf.viterbi, sought only where a word can be other than outside."""
    labels = np.zeros(len(scores), np.int8)
    moves = field.moves
    # The most that labels beside a word can add to another label of it over outside.
    into = np.maximum((moves - moves[:, :1]).max(0), field.first - field.first[0])
    out = np.maximum((moves - moves[:1]).max(1), 0)
    gain = scores + into + out - scores[:, :1]
    open_ = gain[:, 1:].max(1) >= -1e-6
    begins = np.zeros(len(scores), bool)
    begins[np.cumsum(lengths) - lengths] = True
    # Those beside an open word, in its chain, bound its path.
    kept = open_.copy()
    kept[1:] |= open_[:-1] & ~begins[1:]
    kept[:-1] |= open_[1:] & ~begins[1:]
    at = np.flatnonzero(kept)
    if not len(at):
        return labels
    own = scores[at].copy()
    own[~open_[at], 1:] = -1e30
    cuts = np.flatnonzero(np.append(True, np.diff(at) > 1) | begins[at])
    labels[at] = crf.viterbi(field, own, np.diff(np.append(cuts, len(at))))
    return labels


def train(docs: DataFrame) -> crf.Chain | None:
    """The field, from a bounded sample of documents; None if no word of it is labelled."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS).toPandas()["id"]
    # At most TRAIN_DOCUMENTS ids; the first are those that also train without a label.
    looked = docs.sparkSession.createDataFrame([(int(i), k < TRAIN_PLAIN) for k, i in enumerate(ids)], "id long, plain boolean")
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(looked), "id")

    @textbatch.lean
    def labelled(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            ids, plain = table.column("id").to_pylist(), table.column("plain").to_pylist()
            for low, high, texts, chains, spans in _sliced(table.column("text")):
                labels = _labels(chains, spans)
                shapes, own = chains.shapes.astype(np.float32), chains.features.places[0]
                found = []
                for row, (first, last) in enumerate(itertools.pairwise(np.searchsorted(chains.rows, np.arange(high - low + 1)).tolist())):
                    marked = bool(labels[first:last].any())
                    for begin, end in _windows(labels[first:last]) if marked or plain[low + row] and first < last else ():
                        before, after = min(begin, 2), min(last - first - end, 1)
                        words, places = np.unique(own[first + begin - before : first + end + after], return_inverse=True)
                        found.append((
                            ids[low + row], marked, begin, before, chains.density[row], chains.named[row],
                            labels[first + begin : first + end].astype(np.int8).tobytes(), shapes[words].tobytes(),
                            places.astype(np.int32).tobytes(),
                        ))
                columns = list(zip(*found)) if found else [()] * 9
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64()] + [pa.float64()] * 2 + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays(
                    list(map(pa.array, columns, kinds)),
                    names=["id", "marked", "nth", "before", "density", "named", "labels", "shapes", "places"],
                )

    got = chosen.select("id", "plain", "text").mapInArrow(
        labelled, "id long, marked boolean, nth long, before long, density double, named double, labels binary, shapes binary, places binary"
    ).toPandas().sort_values(["id", "nth", "shapes", "places"], kind="stable")
    labels = np.frombuffer(b"".join(got["labels"]), np.int8).astype(np.int64)
    if not labels.any():
        return None
    # One table of the distinct shapes of all windows, and one without any.
    shapes = np.frombuffer(b"".join(got["shapes"]), np.float32).reshape(-1, SHAPES)
    shapes, distinct = np.unique(np.vstack([np.zeros((1, SHAPES), np.float32), shapes]), axis=0, return_inverse=True)
    none, distinct = distinct[0], distinct[1:]
    parts = got["shapes"].map(len).to_numpy() // (4 * SHAPES)
    sizes = got["places"].map(len).to_numpy() // 4
    words = distinct[np.frombuffer(b"".join(got["places"]), np.int32) + np.repeat(np.cumsum(parts) - parts, sizes)]
    lengths = got["labels"].map(len).to_numpy()
    window = np.repeat(np.arange(len(got)), lengths)
    begin = (np.cumsum(sizes) - sizes)[window]
    end = begin + sizes[window]
    own = begin + got["before"].to_numpy()[window] + np.arange(len(labels)) - (np.cumsum(lengths) - lengths)[window]

    def beside(at: np.ndarray) -> np.ndarray:
        inside = (at >= begin) & (at < end)
        return np.where(inside, words[np.where(inside, at, 0)], none)

    places = [beside(own), beside(own - 1), beside(own + 1), beside(own - 2)]
    whole = np.stack([np.ones(len(labels)), got["density"].to_numpy()[window], got["named"].to_numpy()[window]], axis=1)
    marked = got["marked"].to_numpy(bool)
    others, stand_ins = len(ids) - got["id"][marked].nunique(), got["id"][~marked].nunique()
    weights = np.where(marked, 1.0, others / max(stand_ins, 1))
    return crf.train(
        Features(shapes.astype(float), places, whole), labels, lengths, 3, TRAIN_PENALTY, gain=TRAIN_GAIN, sequence_weights=weights
    )


def _sliced(texts: pa.Array):
    """(first row, end row, texts, chains, base spans by row) of slices of a column."""
    for low, high, data, offsets in textbatch.slices(*textbatch.bytes_of(texts), SLICE_BYTES):
        own = [text or "" for text in texts.slice(low, high - low).to_pylist()]
        spans = {row: found for row in _suspects(data, offsets) if (found := base_spans(own[row]))}
        yield low, high, own, Chains(data, offsets, own), spans


def _added(chains: Chains, spans: dict, field: crf.Chain | None) -> dict[int, list[tuple[str, int, int]]]:
    """The field's spans by row, without those that a base span overlaps."""
    added: dict[int, list[tuple[str, int, int]]] = {}
    if field is None or not len(chains.rows):
        return added
    labels = viterbi(field, field.scores(chains.features), chains.lengths)
    opens = np.zeros(len(labels), bool)
    opens[np.append(0, np.cumsum(chains.lengths)[:-1])] = True
    inside = labels != OUTSIDE
    begins = inside & (opens | (labels == BEGIN) | np.append(True, ~inside[:-1]))
    at = np.flatnonzero(inside)
    if not len(at):
        return added
    firsts = np.flatnonzero(begins[at])
    for low, high in zip(at[firsts].tolist(), at[np.append(firsts[1:], len(at)) - 1].tolist()):
        row = int(chains.rows[low])
        word, last = chains.word(low), chains.word(high)
        start = int(chains.starts[low]) + len(word) - len(word.lstrip(_TRIM))
        end = int(chains.ends[high]) - len(last) + len(last.rstrip(_TRIM))
        if end - start >= LEAST_ADDED and not any(start < b and a < end for _, a, b in spans.get(row, ())):
            added.setdefault(row, []).append(("crf", start, end))
    return added


def spans_of(texts: pa.Array, field: crf.Chain | None) -> Iterator[tuple[list, list]]:
    """Base spans and all spans of each text."""
    for low, high, _, chains, spans in _sliced(texts):
        added = _added(chains, spans, field)
        for row in range(high - low):
            base = spans.get(row, [])
            yield base, _ordered(base + added.get(row, []))


def scan(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest and all spans of each row."""
    field = train(docs)

    @textbatch.lean
    def found(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = []
            for base, every in spans_of(table.column("text"), field):
                kinds = [kind for kind, _, _ in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*map(kinds.count, KINDS[:3]), digest, joined(every)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id"), *map(pa.array, columns, kinds)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(found, FOUND)


def without(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the mark."""
    out, end = [], 0
    for _, low, high in spans:
        if low >= end:
            out += [text[end:low], MARK]
        end = max(end, high)
    return "".join(out) + text[end:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with its spans replaced in ``text``, and ``n_chars`` counted anew."""
    field = train(docs)
    columns = docs.columns

    @textbatch.lean
    def replaced(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            texts = table.column("text")
            out = [
                text and without(text, every)
                for text, (_, every) in zip(texts.to_pylist(), spans_of(texts, field))
            ]
            yield table.set_column(columns.index("text"), "text", pa.array(out, texts.type))

    out = docs.mapInArrow(replaced, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out
