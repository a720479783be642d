"""Byte-level BPE encoding and decoding.

Each text is cut into pieces by the tokenizer's pattern. Within one batch of documents the
pieces are reduced to the distinct ones. The ranked merges are folded over the byte arrays
of all distinct pieces at once: in each turn every piece merges its pair of least rank, the
leftmost of equals, which it finds in a rank map of pairs, until no piece has a pair left.
Decoding concatenates the tokens' binary pieces. The results of the distinct pieces are
then spread over the documents of the batch. Nothing is shuffled, and no task holds more
than one batch.

The fold over Spark's higher-order functions gave the same ids, but took more memory and
time than a cluster's executor has here; the README gives the figures.

Defined results: a null or empty text has no tokens; its digests are those of the empty
byte string. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import array
import base64
import collections
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackquarry.llm import textbatch

#: Characters of text whose pieces are reduced together; a longer text is its own batch.
BATCH = 4 << 20
#: Slots of the rank map; a vocabulary of 50,000 tokens has about 110,000 pairs.
SLOTS = 1 << 19
#: A slot of no pair: greater than every symbol's. And the least value that is no rank.
FREE, NO_RANK = 1 << 40, 1 << 17
#: Bytes from which a piece is merged by itself, as it takes many turns.
LONG = 128

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.lru_cache(maxsize=2)
def token_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token's bytes."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankMap:
    """The rank that each pair of symbols merges to. A symbol is a byte's value, or the
    rank of a longer token. The slots of a left symbol's pairs begin at its place: the one
    at place + right holds left * 131072 + rank if the two merge."""

    def __init__(self, ranks: dict[bytes, int]):
        symbol = {token: token[0] if len(token) == 1 else rank for token, rank in ranks.items()}
        rows: dict[int, list[tuple[int, int]]] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = symbol.get(token[:cut]), symbol.get(token[cut:])
                if left is not None and right is not None:
                    rows.setdefault(left, []).append((right, rank))
        most = max(ranks.values(), default=0) + 1
        if most >= 65536 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be below 65536 and hold every byte")
        self.slots = np.full(SLOTS + 65536, FREE, np.int64)
        self.places = np.full(65536, SLOTS, np.int64)
        tries = np.random.default_rng(0)
        for left in sorted(rows, key=lambda left: (-len(rows[left]), left)):
            rights = np.array([right for right, _ in rows[left]])
            fits = np.empty(0, np.int64)
            while not len(fits):
                starts = tries.integers(0, SLOTS, 64)
                fits = starts[(self.slots[starts[:, None] + rights] == FREE).all(1)]
            self.places[left] = fits[0]
            self.slots[fits[0] + rights] = (left << 17) + np.array([rank for _, rank in rows[left]])
        #: From symbols to ranks, and from ranks to binary pieces.
        self.ids = np.arange(65536)
        self.ids[:256] = [ranks[bytes([b])] for b in range(256)]
        self.pieces = [b""] * most
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; at least NO_RANK where they don't merge."""
        return self.slots[self.places[left] + right] ^ (left << 17)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The merges of one piece, with the pairs in a heap."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        firsts, seconds = np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)
        heap = [(rank, at, after[at]) for at, rank in enumerate(self.rank(firsts, seconds).tolist()) if rank < NO_RANK]
        pair = {at: rank for rank, at, _ in heap}
        heapq.heapify(heap)

        def renew(at: int) -> None:
            pair.pop(at, None)
            if at >= 0 and after[at] < n:
                rank = int(self.slots[self.places[symbols[at]] + symbols[after[at]]]) ^ (symbols[at] << 17)
                if rank < NO_RANK:
                    pair[at] = rank
                    heapq.heappush(heap, (rank, at, after[at]))

        while heap:
            rank, at, right = heapq.heappop(heap)
            if pair.get(at) != rank or after[at] != right:
                continue
            symbols[at] = rank
            after[at] = after[right]
            pair.pop(right, None)
            if after[right] < n:
                before[after[right]] = at
            renew(at)
            renew(before[at])
        out, at = [], 0
        while at < n:
            out.append(symbols[at])
            at = after[at]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and where each piece's begin."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done: list[tuple[np.ndarray, np.ndarray]] = []  # piece of each symbol, symbols
        long = np.flatnonzero(lengths > LONG)
        for k in long.tolist():
            merged = np.array(self.merge_long(list(pieces[k])))
            done.append((np.full(len(merged), k), merged))
        short = np.flatnonzero(lengths <= LONG)
        symbols = np.frombuffer(b"".join(pieces[k] for k in short.tolist()), np.uint8).astype(np.int64)
        owner = np.repeat(short, lengths[short])
        while len(symbols):
            firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            ranked = np.full(len(symbols), FREE << 17, np.int64)
            ranked[:-1] = self.rank(symbols[:-1], symbols[1:])
            ranked[firsts[1:] - 1] = FREE << 17
            ranked = np.minimum(ranked, NO_RANK) << 40 | np.arange(len(symbols))
            best = np.minimum.reduceat(ranked, firsts)
            open_ = best < NO_RANK << 40
            at = best[open_] & ((1 << 40) - 1)
            symbols[at] = best[open_] >> 40
            going = np.repeat(open_, np.diff(np.append(firsts, len(symbols))))
            done.append((owner[~going], symbols[~going]))
            going[at + 1] = False
            owner, symbols = owner[going], symbols[going]
        if not done:
            return np.empty(0, np.int64), np.zeros(len(pieces) + 1, np.int64)
        owners = np.concatenate([part for part, _ in done])
        order = np.argsort(owners, kind="stable")
        ids = self.ids[np.concatenate([part for _, part in done])[order]]
        return ids, np.append(0, np.cumsum(np.bincount(owners, minlength=len(pieces))))


@functools.lru_cache(maxsize=1)
def rank_map(path: str) -> RankMap:
    return RankMap(token_ranks(path))


def _batches(tables: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts, cut where a batch holds BATCH characters."""
    ids, texts, size = [], [], 0
    for table in tables:
        for doc_id, text in zip(table.column(0), table.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1]) + 64
            if size >= BATCH:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


#: White space beside a space: there a text is not cut at its spaces.
WIDE = re.compile(r"\s | \s")


def _chunks(text: str) -> list[str]:
    """Cut before every space, where each one stands between two characters that are not
    white space: a piece of the pattern never goes on over such a place, and what stands
    before it does not matter to the pieces behind it. Else the whole text."""
    if WIDE.search(text):
        return [text]
    first, *rest = text.split(" ")
    return [first] * bool(first) + [" " + part for part in rest]


def _flat(values: np.ndarray, cuts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen rows of a ragged array, one after the other."""
    starts, lengths = cuts[chosen], cuts[chosen + 1] - cuts[chosen]
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def encode_texts(texts: list[str], ranks: RankMap, pattern: str) -> Iterator[tuple[np.ndarray, bytes]]:
    """Token ids, and the bytes they decode to, of each text."""
    find = regex.compile(pattern).findall
    # Numbers by first use. (A default that names its own dictionary would keep it alive
    # after the batch, until the cycle is collected.)
    places: dict[str, int] = collections.defaultdict(itertools.count().__next__)
    refs = []
    for text in texts:
        chunks = _chunks(text)
        refs.append(np.fromiter(map(places.__getitem__, chunks), np.int32, len(chunks)))
    pieces: dict[str, int] = collections.defaultdict(itertools.count().__next__)
    of_chunk, cuts = array.array("i"), array.array("i", [0])
    for chunk in places:
        of_chunk.extend(map(pieces.__getitem__, find(chunk)))
        cuts.append(len(of_chunk))
    ids, id_cuts = ranks.encode([piece.encode() for piece in pieces])
    # From distinct pieces to distinct chunks, and from those to the texts.
    members, bounds = np.array(of_chunk, np.int64), np.array(cuts)
    counts = np.append(0, np.cumsum(np.diff(id_cuts)[members]))
    ids, id_cuts = _flat(ids, id_cuts, members), counts[bounds]
    tokens, low = list(map(ranks.pieces.__getitem__, ids.tolist())), id_cuts.tolist()
    decoded = [b"".join(tokens[a:b]) for a, b in zip(low, low[1:])]
    for own in refs:
        yield _flat(ids, id_cuts, own), b"".join(map(decoded.__getitem__, own.tolist()))


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count, digest of the token ids (little-endian, 32 bits each) and digest of
    the decoded bytes of each row."""

    @textbatch.lean
    def digests(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_map(path)
        for doc_ids, texts in _batches(tables):
            rows = [
                (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
                for ids, text in encode_texts(texts, ranks, pattern)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), *map(pa.array, zip(*rows))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(digests, ENCODED)
