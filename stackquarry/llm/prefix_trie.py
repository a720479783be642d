"""The prefix trie of conversations, built by z-fast tries.

Each conversation is rebuilt: it borrows its first turns from the first of its block of
twenty, then goes on with its own. A prefix is named by a 128-bit digest, the exclusive-or of
its turns' digests mixed with their depths, so that digests of segments add up in any order.

Rows are range-sorted by conversation and depth. Each task inserts the conversations of a
batch into a z-fast trie: its nodes are compacted, and a hash table knows each by the digest
of its handle, the prefix whose length is the two-fattest number on the node's edge. Fat
binary search over handles finds where a conversation leaves the trie in a logarithm of its
length. The expanded edges of all tasks are added up by digest; a task lets its trie go once
it holds HELD turns, so its memory is bounded. A conversation that crosses a border of tasks,
or has over SEGMENT turns, is inserted in segments: each hangs on the digest before it, which
is known from the segments' totals. Sums over subtrees take pointer doubling: a logarithm of
the depth in rounds, with each node once in a round, however deep or wide the trie is.

Defined results: rows with a null conversation id belong to no conversation. Null roles and
texts are empty. Equal turns are ordered by the beginnings of role and text, then by their
digest; repeated rows are turns of their own. A conversation's block begins at its id minus
the remainder by 20, whose sign is the id's. No conversation, no node. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackquarry.llm.shared import dropped, shared_table
from stackquarry.llm.textbatch import mixed

#: Conversations of a block share the turns of its first; a quarter each shares 0 to 3.
BLOCK, SHARED = 20, 4
#: Turns that a task's trie holds before it is let go, and turns of a segment.
HELD = 400_000
SEGMENT = 4096
WORD = r"[^\x20\x09-\x0D]+"

TURN = "conv_id long, part long, nth long, a long, b long, words long"
NODE = "depth long, a long, b long, pa long, pb long, words long, conv_id long, n long, first long, ids string"
PIECE = "part long, seg long, low long, one array<long>, two array<long>, sizes array<long>, x1 long, x2 long"
_NODE_NAMES = [part.split()[0] for part in NODE.split(", ")]
_NODE_KINDS = [pa.int64()] * 9 + [pa.string()]
_PIECE_NAMES = [part.split()[0] for part in PIECE.split(", ")]
_PIECE_KINDS = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3 + [pa.int64()] * 2
_LOW = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that most powers of two divide."""
    return high & -(1 << ((low ^ high).bit_length() - 1))


class Node:
    """An edge and the node at its end: prefixes of lengths (top, end] of ``digests``."""

    __slots__ = ("digests", "words", "base", "top", "end", "children", "weight", "least", "ids")

    def __init__(self, digests: list[int], words: list[int], base: int, top: int, end: int):
        self.digests, self.words, self.base, self.top, self.end = digests, words, base, top, end
        self.children: dict[int, Node] = {}
        self.weight, self.least, self.ids = 0, None, []

    def digest(self, depth: int) -> int:
        return self.digests[depth - self.base]


class Trie:
    """Z-fast tries of strings that hang on given prefixes."""

    def __init__(self):
        self.roots: dict[tuple[int, int], tuple[Node, dict[int, Node]]] = {}
        self.held = 0

    def insert(self, base: int, digests: list[int], words: list[int], ids: list[int], ends: bool) -> None:
        """A string from depth ``base`` on: the digest there and after each turn, the turns'
        words, the conversations that read so, and whether they end with it."""
        end = base + len(words)
        if (base, digests[0]) not in self.roots:
            self.roots[base, digests[0]] = Node(digests[:1], [], base, base, base), {}
        root, handles = self.roots[base, digests[0]]
        node = self._place(self._leave(root, handles, base, digests, end), handles, base, digests, words, end)
        node.weight += len(ids)
        node.least = min(ids) if node.least is None else min(node.least, min(ids))
        if ends:
            node.ids += ids
        self.held += len(ids)

    def _leave(self, root: Node, handles: dict[int, Node], base: int, digests: list[int], end: int) -> Node:
        """The deepest node that is a prefix of the string, by fat binary search."""
        node, low, high = root, base, end
        while low < high:
            at = fattest(low, high)
            met = handles.get(digests[at - base])
            if met is None:
                high = at - 1
            elif met.end <= end and met.digest(met.end) == digests[met.end - base]:
                node, low = met, met.end
            else:
                # The string leaves within this edge: its top is the node sought.
                high = met.top
        return node

    def _place(self, node: Node, handles: dict[int, Node], base: int, digests: list[int], words: list[int], end: int) -> Node:
        """The node of the whole string below ``node``, made if there is none."""
        if node.end == end:
            return node
        first = digests[node.end + 1 - base]
        child = node.children.get(first)
        if child is None:
            self.held += end - node.end
            return self._hang(node, Node(digests, words, base, node.end, end), handles)
        # Within the edge, prefixes are equal up to where the string leaves it.
        low, high = child.top + 1, min(child.end, end)
        while low < high:
            middle = (low + high + 1) // 2
            if child.digest(middle) == digests[middle - base]:
                low = middle
            else:
                high = middle - 1
        del handles[child.digest(fattest(child.top, child.end))]
        between = self._hang(node, Node(child.digests, child.words, child.base, child.top, low), handles)
        child.top = low
        self._hang(between, child, handles)
        if low == end:
            return between
        self.held += end - low
        return self._hang(between, Node(digests, words, base, low, end), handles)

    def _hang(self, node: Node, child: Node, handles: dict[int, Node]) -> Node:
        node.children[child.digest(child.top + 1)] = child
        handles[child.digest(fattest(child.top, child.end))] = child
        return child

    def rows(self) -> Iterator[tuple]:
        """Every prefix: depth, digest, digest before, words, least conversation, number,
        and the first and all of those that end there, ascending and joined."""
        for root, _ in self.roots.values():
            order, stack = [], [root]
            while stack:
                node = stack.pop()
                order.append(node)
                stack += node.children.values()
            for node in reversed(order):
                for child in node.children.values():
                    node.weight += child.weight
                    node.least = child.least if node.least is None else min(node.least, child.least)
            for node in order:
                ids = sorted(node.ids)
                tail = (ids[0], ",".join(map(str, ids))) if ids else (None, None)
                if node is root and root.base == 0:
                    yield 0, 0, 0, 0, 0, 0, node.least, node.weight, *tail
                for depth in range(node.top + 1, node.end + 1):
                    own, before = node.digest(depth), node.digest(depth - 1)
                    yield (
                        depth, _signed(own >> 64), _signed(own & _LOW), _signed(before >> 64), _signed(before & _LOW),
                        node.words[depth - node.base - 1], node.least, node.weight,
                        *(tail if depth == node.end else (None, None)),
                    )


def _lanes(table: pa.RecordBatch) -> tuple[list[int], list[int]]:
    """The turns' digests mixed with their depths."""
    depth = table.column("depth").to_numpy(zero_copy_only=False).astype(np.uint64)
    lanes = []
    for name, seed in (("a", 0x1D8E4E27C47D124F), ("b", 0xEB44ACCAB455D165)):
        own = table.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        lanes.append(mixed(own + mixed(depth ^ np.uint64(seed))).tolist())
    return lanes[0], lanes[1]


def _insert_all(trie: Trie, batch: dict[tuple, tuple[int, list[int], list[int], list[int], bool]]) -> None:
    """A batch of strings, equal ones together."""
    for base, digests, words, ids, ends in batch.values():
        trie.insert(base, digests, words, ids, ends)
    batch.clear()


def _emitted(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _nodes(tables: Iterator[pa.RecordBatch], segment: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns to the expanded tries of whole conversations, and segments of others."""
    names, kinds = _NODE_NAMES + _PIECE_NAMES, _NODE_KINDS + _PIECE_KINDS
    none = [None] * len(_PIECE_NAMES)
    part, seg = TaskContext.get().partitionId(), 0
    trie, batch = Trie(), {}
    current, started, opened, low = None, False, True, 0
    one, two, sizes = [], [], []
    segments: list[tuple] = []

    def cut(whole: bool) -> None:
        nonlocal seg, one, two, sizes
        if whole:
            digests = [0]
            for a, b in zip(one, two):
                digests.append(digests[-1] ^ (a << 64 | b))
            batch.setdefault((len(sizes), digests[-1]), (0, digests, sizes, [], True))[3].append(current)
        else:
            x1, x2 = (int(np.bitwise_xor.reduce(np.array([0, *lane], np.uint64))) for lane in (one, two))
            segments.append((
                *[None] * 6, current, *[None] * 3, part, seg, low, list(map(_signed, one)), list(map(_signed, two)), sizes,
                _signed(x1), _signed(x2),
            ))
            seg += 1
        one, two, sizes = [], [], []

    for table in tables:
        first, second = _lanes(table)
        columns = (table.column(name).to_pylist() for name in ("conv_id", "depth", "words"))
        for conv_id, depth, words, a, b in zip(*columns, first, second):
            if not started or conv_id != current:
                if started:
                    cut(not opened)
                opened, started, current, low = not started, True, conv_id, max(depth - 1, 0)
            if not depth:
                continue
            if len(sizes) >= segment:
                opened = True
                cut(False)
                low = depth - 1
            one.append(a)
            two.append(b)
            sizes.append(words)
        _insert_all(trie, batch)
        yield _emitted(segments, names, kinds)
        segments.clear()
        if trie.held >= most:
            yield from _expanded(trie, names, kinds, none)
            trie = Trie()
    if started:
        cut(False)
    yield _emitted(segments, names, kinds)
    yield from _expanded(trie, names, kinds, none)


def _expanded(trie: Trie, names: list[str], kinds: list[pa.DataType], none: list = []) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in trie.rows():
        rows.append((*row, *none))
        if len(rows) >= 10_000:
            yield _emitted(rows, names, kinds)
            rows = []
    yield _emitted(rows, names, kinds)


def _hung(tables: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Segments to their expanded tries; each hangs on the digest before it."""
    trie = Trie()
    for table in tables:
        batch: dict = {}
        for row in table.to_pylist():
            digests = [(row["before1"] & _LOW) << 64 | row["before2"] & _LOW]
            for a, b in zip(row["one"], row["two"]):
                digests.append(digests[-1] ^ ((a & _LOW) << 64 | b & _LOW))
            key = (row["low"], digests[0], digests[-1], row["last"])
            batch.setdefault(key, (row["low"], digests, row["sizes"], [], row["last"]))[3].append(row["conv_id"])
        _insert_all(trie, batch)
        if trie.held >= most:
            yield from _expanded(trie, _NODE_NAMES, _NODE_KINDS)
            trie = Trie()
    yield from _expanded(trie, _NODE_NAMES, _NODE_KINDS)


def _numbered(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each sorted row among its conversation's in this task."""
    part, current, nth = TaskContext.get().partitionId(), None, 0
    for table in tables:
        places = []
        for conv_id in table.column("conv_id").to_pylist():
            nth = nth + 1 if conv_id == current else 1
            current = conv_id
            places.append(nth)
        yield pa.RecordBatch.from_arrays(
            [table.column("conv_id"), pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64()),
             *(table.column(name) for name in ("a", "b", "words"))],
            names=[name.split()[0] for name in TURN.split(", ")],
        )


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (digest of role and text), words of each turn of each rebuilt
    conversation; one row of depth 0 for those without turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = [F.conv(F.substring(whole, start, 16), 16, -10).cast("bigint") for start in (1, 17)]
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint"), "turn", F.substring(role, 1, 32).alias("r"), F.substring(text, 1, 64).alias("t"),
        half[0].alias("a"), half[1].alias("b"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        F.monotonically_increasing_id().alias("id"),
    )
    order = ["conv_id", "turn", "r", "t", "a", "b", "id"]
    # Written first: a range exchange reads its input twice, and texts are digested once.
    digested = shared_table(turns, "digests")
    ranged = digested.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = shared_table(ranged.mapInArrow(_numbered, TURN), "turns")
    dropped(digested)
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    own = Window.partitionBy("conv_id").orderBy("part")
    carried = parts.withColumn("carried", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1))).where("carried > 0")
    placed = placed.join(carried.select("conv_id", "part", "carried"), ["conv_id", "part"], "left").withColumn(
        "nth", F.col("nth") + F.coalesce("carried", F.lit(0).cast("long"))
    )
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    head = F.col("conv_id") - F.col("conv_id") % BLOCK
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    heads = sizes.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("head"), F.col("n_own").alias("n_head"))
    convs = sizes.select("conv_id", "n_own", share.alias("share"), head.alias("head")).join(heads, "head", "left").withColumn(
        "borrowed", F.least("share", F.coalesce("n_head", F.lit(0)))
    )
    first = placed.where((F.col("conv_id") % BLOCK == 0) & (F.col("nth") < SHARED)).select(
        F.col("conv_id").alias("head"), F.col("nth").alias("depth"), "a", "b", "words"
    )
    lent = convs.where("borrowed > 0").select("conv_id", "head", "borrowed").join(first, "head").where("depth <= borrowed")
    # Conversations of which the head has fewer turns to lend move up.
    short = convs.where("borrowed < share").select("conv_id", (F.col("share") - F.col("borrowed")).alias("short"))
    rest = placed.where(F.col("nth") > share).join(short, "conv_id", "left").withColumn(
        "depth", F.col("nth") - F.coalesce("short", F.lit(0))
    )
    bare = convs.where("borrowed = 0 and n_own <= share").select(
        "conv_id", *[F.lit(0).cast("bigint").alias(name) for name in ("depth", "a", "b", "words")]
    )
    columns = ["conv_id", "depth", "a", "b", "words"]
    return lent.select(*columns).unionByName(rest.select(*columns)).unionByName(bare)


def _digests(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined ids of each node, from its pieces in order."""
    kinds = [pa.int64()] * 3 + [pa.string()]
    key, state, out = None, None, []
    for table in tables:
        columns = (table.column(name).to_pylist() for name in ("depth", "a", "b", "ids"))
        for *own, ids in zip(*columns):
            if own != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _emitted(out, ["depth", "a", "b", "ends_sha256"], kinds)
        out = []
    if key is not None:
        yield _emitted([(*key, state.hexdigest())], ["depth", "a", "b", "ends_sha256"], kinds)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """depth, a, b, n_leaves, saved_tokens over the subtree of each node, by doubling: after
    round k a node has the sums of what lies less than 2**k below it, and knows the prefix
    2**k above it."""
    key = ["depth", "a", "b"]
    current = shared_table(
        nodes.select(*key, "pa", "pb", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                     ((F.col("n") - 1) * F.col("words")).alias("saved_tokens")), "subtrees")
    deepest = current.agg(F.max("depth").alias("n")).first()["n"] or 0
    step = 1
    while step <= deepest:
        below = current.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens")
        )
        above = current.where(F.col("depth") >= step).select((F.col("depth") + step).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"),
                                                              F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        far = current.where(F.col("depth") >= 2 * step).select(*key, "pa", "pb").join(above, ["depth", "pa", "pb"]).select(*key, "qa", "qb")
        added = current.join(below, key, "left").join(far, key, "left").select(
            *key, F.col("qa").alias("pa"), F.col("qb").alias("pb"),
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens"),
        )
        before, current = current, shared_table(added, "subtrees")
        dropped(before)
        step *= 2
    return current.select(*key, "n_leaves", "saved_tokens")


def trie(rows: DataFrame, segment: int = SEGMENT, most: int = HELD) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations."""
    ready = shared_table(rebuilt(rows), "rebuilt")
    ranged = ready.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    made = shared_table(ranged.mapInArrow(lambda tables: _nodes(tables, segment, most), f"{NODE}, {PIECE}"), "tries")
    pieces = made.where("part is not null").select("conv_id", *_PIECE_NAMES)
    along = Window.partitionBy("conv_id").orderBy("part", "seg")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    hung = pieces.select(
        "conv_id", "low", "one", "two", "sizes",
        *[F.coalesce(F.bit_xor(f"x{k}").over(earlier), F.lit(0).cast("bigint")).alias(f"before{k}") for k in (1, 2)],
        F.lead("seg").over(along).isNull().alias("last"),
    ).mapInArrow(lambda tables: _hung(tables, most), NODE)
    key = ["depth", "a", "b"]
    partial = shared_table(made.where("part is null").select(*_NODE_NAMES).unionByName(hung), "nodes")
    merged = partial.groupBy(*key).agg(
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("words").alias("words"), F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n"),
    )
    children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children")
    )
    nodes = shared_table(merged.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "prefixes")
    ends = partial.where("ids is not null").select(*key, "first", "ids").repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(
        _digests, "depth long, a long, b long, ends_sha256 string"
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(_subtrees(nodes), key)
        .join(ends, key, "left")
        .join(parents, ["depth", "pa", "pb"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
