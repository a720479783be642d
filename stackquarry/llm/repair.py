"""Repair of the turn structure of conversations by iterative-deepening A*.

A conversation is sound if its roles read an optional system turn and then user and
assistant in turns, or if it has no turn. Edits keep, re-role, delete or insert a turn; the
cheapest ones are sought depth first, in the ASCII order of their initials, under a cost
bound that rises from a lower bound of the cost (see ``at_least``). A table of failed states
(turn, role state, inserts just made, with the largest budget that failed) holds over all
bounds. The first path that ends in order is the cheapest one whose initials come first.

Rows are range-sorted, so a conversation of any length is spread over tasks in order. One
that lies within a task and has up to SEGMENT turns is repaired there. Others are cut into
segments: each finds its cheapest costs between role states on its own, a pass over these
few numbers tells every segment what the turns behind it cost from each role state, each
segment is searched with that, and a last pass in order puts paths and texts together. As
inserts stand before a turn of their own segment, or at the very end, no path is a beginning
of another, and first paths of segments make the first path of the whole.

Defined results: a null conversation id is one conversation, with a null id. Null ids and
turns read as one space in the key that chooses the damage; so do null roles and texts.
Equal turns are ordered by the beginnings of role and text, then by their hash. A role's
initial is its first character, an empty role has none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackquarry.llm.shared import shared_table

#: Turns, and characters of text, of a segment at most; a longer text by itself.
SEGMENT = 64
SEGMENT_CHARS = 4 << 20

SPACE = " \t\n\x0b\x0c\r"
#: Role states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the only role that may be inserted or set, and that role.
NEXT = [USER, USER, ASSISTANT, USER]
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
RISE = {"D": 3, "I": 2, "R": 2, "K": 0}
#: What ending in each state costs: the inserts that complete it.
ENDS = [0, 4, 2, 0]
#: More inserts in a row only come back to a state they have been in.
MOST_INSERTS = 2
LEGAL = {"su", "ua", "au"}

FAULTS = ("blank", "duplicate", "truncated")
OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
NAMES = [part.split()[0] for part in OUT.split(", ")]
PIECE = "part long, seg long, turns array<long>, roles array<string>, texts array<string>, digests array<string>"
KINDS = [pa.int64()] * 7 + [pa.string()] * 2
PIECE_KINDS = [pa.int64()] * 2 + [pa.list_(pa.int64())] + [pa.list_(pa.string())] * 3


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after damage by their key. Dropped rows stay,
    marked, so that their conversation does."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("kind")
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("kind"))
    return out.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), (kind == 0).alias("dropped"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        copies.alias("copies"),
    ).withColumn("copy", F.explode("copies")).drop("copies", "copy")


def fault(role: str, text: str, seen: bool) -> str | None:
    """The first fault of a turn."""
    core = text.rstrip(SPACE)
    if not core:
        return "blank"
    return "duplicate" if seen else None if core[-1] in ".!?" else "truncated"


def at_least(turns: list[tuple[str, str | None]]) -> list[int]:
    """A lower bound of the cost of the turns from each on. Faults cost what they must; and
    of turns that follow each other, once the bad ones are gone, each pair whose roles can't
    takes an insert between them or an edit of one of them, 2 above its fault at least. Only
    pairs without a turn in common are counted."""
    faults, pairs = [0] * (len(turns) + 1), [0] * (len(turns) + 1)
    after, beyond = None, 0  # the next turn that may stay, and the pairs behind that one
    for k in range(len(turns) - 1, -1, -1):
        initial, name = turns[k]
        pairs[k] = pairs[k + 1]
        if name not in (None, "truncated"):
            faults[k] = faults[k + 1] + 3
            continue
        faults[k] = faults[k + 1] + (name is not None)
        if initial not in ("s", "u", "a"):
            pairs[k] += 1
        elif after is not None and initial + after not in LEGAL:
            pairs[k] = max(pairs[k], 1 + beyond)
        after, beyond = initial, pairs[k + 1]
    return [fault + 2 * pair for fault, pair in zip(faults, pairs)]


def search(
    turns: list[tuple[str, str | None]], entry: int = START, ends: list[float] = ENDS,
    failed: dict[int, float] | None = None, most: float = math.inf,
) -> tuple[float, str, int]:
    """Cost, initials and last role state of the first of the cheapest paths over turns
    (initial, fault), from a role state; ``ends`` is what ending in each state costs."""
    n, failed = len(turns), {} if failed is None else failed
    least = [cost + min(ends) for cost in at_least(turns)]
    path: list[str] = []
    last = entry

    def reach(at: int, state: int, inserts: int, budget: float) -> bool:
        nonlocal last
        if at == n:
            last = state
            return ends[state] <= budget
        if budget < least[at]:
            return False
        key = (at * 4 + state) * 3 + inserts
        if failed.get(key, -1) >= budget:
            return False
        initial, name = turns[at]
        free, extra = name is None or name == "truncated", 1 if name == "truncated" else 0
        path.append("D")
        if reach(at + 1, state, 0, budget - 3):
            return True
        if inserts < MOST_INSERTS:
            path[-1] = "I"
            if reach(at, NEXT[state], inserts + 1, budget - 2):
                return True
        if free and initial in KEEPS[state]:
            path[-1] = "K"
            if reach(at + 1, KEEPS[state][initial], 0, budget - extra):
                return True
        if free:
            path[-1] = "R"
            if reach(at + 1, NEXT[state], 0, budget - 2 - extra):
                return True
        path.pop()
        failed[key] = budget
        return False

    bound = least[0]
    while not reach(0, entry, 0, bound):
        bound += 1
        if bound > most:
            return math.inf, "", entry
    return bound, "".join(path), last


def costs(turns: list[tuple[str, str | None]]) -> list[list[float]]:
    """The cheapest cost from each role state to each, inf where there is no path."""
    n = len(turns)
    out = [[math.inf] * 4 for _ in range(4)]
    # To still have nothing, or only the system turn, every other turn is deleted.
    out[START][START] = out[SYSTEM][SYSTEM] = 3 * n
    opening = [name is not None for initial, name in turns if initial == "s" and name in (None, "truncated")]
    if opening:
        out[START][SYSTEM] = 3 * (n - 1) + min(opening)
    for to in (USER, ASSISTANT):
        ends = [0.0 if state == to else math.inf for state in range(4)]
        failed: dict[int, float] = {}
        for entry in range(4):
            out[entry][to] = search(turns, entry, ends, failed, 3 * n + 4)[0]
    return out


def rewritten(path: str, rows: list[tuple[str, str]], state: int) -> Iterator[str]:
    """``role:text`` of each turn that a path leaves or inserts."""
    at = 0
    for edit in path:
        if edit == "I":
            state = NEXT[state]
            yield ROLE[state] + ":"
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            state = KEEPS[state][role[0]]
            yield f"{role}:{text}"
        elif edit == "R":
            state = NEXT[state]
            yield f"{ROLE[state]}:{text}"


class Report:
    """Counts and digest of one conversation, fed with its turns in order."""

    def __init__(self):
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal = self.distinct = self.cost = 0
        self.first = self.turn = self.initial = None
        self.paths: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def turns(self, turns: list[int | None], codes: list[tuple[str, str | None]]) -> None:
        for turn, (initial, name) in zip(turns, codes):
            if name:
                self.faults[name] += 1
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.illegal += 1
            self.initial = initial
            if turn is not None:
                self.first = turn if self.first is None else self.first
                self.distinct += turn != self.turn
                self.turn = turn

    def path(self, path: str, rows: list[tuple[str, str]], state: int) -> None:
        self.paths.append(path)
        self.cost += sum(RISE[edit] for edit in path)
        for line in rewritten(path, rows, state):
            self.hash.update((line if self.empty else "\n" + line).encode())
            self.empty = False

    def row(self, conv_id: int | None, undeleted: int) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.first + 1 - self.distinct
        return (conv_id, gaps, *self.faults.values(), self.illegal, self.cost + undeleted, "".join(self.paths), self.hash.hexdigest())


def _codes(roles: list[str], texts: list[str], digests: list[str] = (), late: set[str] = frozenset()) -> list[tuple[str, str | None]]:
    """Initial and fault of each turn; ``late`` are those seen in earlier segments."""
    seen: set[tuple[str, str]] = set()
    out = []
    for k, (role, text) in enumerate(zip(roles, texts)):
        known = (role, text) in seen or (bool(late) and digests[k] in late)
        out.append((role[:1], fault(role, text, known)))
        seen.add((role, text))
    return out


def _undeleted(path: str, codes: list[tuple[str, str | None]]) -> int:
    """Truncated turns that a path doesn't delete."""
    edits = [edit for edit in path if edit != "I"]
    return sum(name == "truncated" and edit != "D" for edit, (_, name) in zip(edits, codes))


def repaired_row(conv_id: int | None, turns: list[int | None], roles: list[str], texts: list[str]) -> tuple:
    """The result of one whole conversation."""
    codes, report = _codes(roles, texts), Report()
    report.turns(turns, codes)
    _, path, last = search(codes)
    report.path(path, list(zip(roles, texts)), START)
    report.path("I" * (ENDS[last] // 2), [], last)
    return report.row(conv_id, _undeleted(path, codes))


def _digest(conv_id: int | None, role: str, text: str) -> str:
    return hashlib.sha256(f"{conv_id}:{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def _pieces(tables: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to results of conversations that lie within the task, and to segments of
    the first, the last and the long ones."""
    part, seg = TaskContext.get().partitionId(), 0
    current, started, opened, n_chars = object(), False, True, 0
    held: tuple[list, list, list] = ([], [], [])
    done: list[tuple] = []

    def cut(whole: bool) -> None:
        nonlocal seg, held, n_chars
        turns, roles, texts = held
        if whole:
            done.append((*repaired_row(current, turns, roles, texts), *[None] * 6))
        else:
            digests = [_digest(current, role, text) for role, text in zip(roles, texts)]
            done.append((current, *[None] * 8, part, seg, turns, roles, texts, digests))
            seg += 1
        held, n_chars = ([], [], []), 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * 15
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, KINDS + PIECE_KINDS)],
            names=NAMES + ["part", "seg", "turns", "roles", "texts", "digests"],
        )

    for table in tables:
        columns = [table.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "dropped")]
        for conv_id, turn, role, text, dropped in zip(*columns):
            if not started or conv_id != current:
                if started:
                    cut(not opened)
                # The task's first conversation may have begun in the task before.
                opened, started, current = not started, True, conv_id
            if dropped:
                continue
            if len(held[0]) >= segment or n_chars + len(text) > SEGMENT_CHARS and held[0]:
                opened = True
                cut(False)
            for own, value in zip(held, (turn, role, text)):
                own.append(value)
            n_chars += len(text)
        yield batch()
    if started:
        cut(False)
    yield batch()


def _open(pieces: DataFrame) -> DataFrame:
    """Results of the conversations that were cut into segments."""
    at = ["part", "seg"]
    seen = pieces.select(*at, F.explode(F.array_distinct("digests")).alias("digest"))
    first = seen.groupBy("digest").agg(F.min(F.struct(*at)).alias("first"), F.count("*").alias("n")).where("n > 1")
    late = seen.join(first, "digest").where(F.struct(*at) != F.col("first")).groupBy(*at).agg(F.collect_set("digest").alias("late"))
    marked = shared_table(pieces.drop(*NAMES[1:]).join(late, at, "left"), "segments")

    def codes_of(row: dict) -> list[tuple[str, str | None]]:
        return _codes(row["roles"], row["texts"], row["digests"], set(row["late"] or ()))

    def measured(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            rows = table.to_pylist()
            numbers = [[c for line in costs(codes_of(row)) for c in line] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [*(table.column(name) for name in ("conv_id", *at)), pa.array(numbers, pa.list_(pa.float64()))],
                names=["conv_id", *at, "costs"],
            )

    def backward(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, behind = object(), ENDS
        for table in tables:
            out = []
            for row in table.to_pylist():
                if row["conv_id"] != current:
                    current, behind = row["conv_id"], ENDS
                out.append([float(c) for c in behind])
                grid = row["costs"]
                behind = [min(grid[4 * a + b] + behind[b] for b in range(4)) for a in range(4)]
            yield pa.RecordBatch.from_arrays(
                [table.column("part"), table.column("seg"), pa.array(out, pa.list_(pa.float64()))], names=[*at, "behind"]
            )

    def searched(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            paths, lasts = [], []
            for row in table.to_pylist():
                codes, failed = codes_of(row), {}
                found = [search(codes, entry, row["behind"], failed) for entry in range(4)]
                paths.append([path for _, path, _ in found])
                lasts.append([last for _, _, last in found])
            yield pa.RecordBatch.from_arrays(
                [table.column("part"), table.column("seg"), pa.array(paths, pa.list_(pa.string())), pa.array(lasts, pa.list_(pa.int64()))],
                names=[*at, "paths", "lasts"],
            )

    def together(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, report, state, undeleted, started = None, Report(), START, 0, False

        def end() -> pa.RecordBatch:
            report.path("I" * (ENDS[state] // 2), [], state)
            row = report.row(current, undeleted)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, KINDS)], names=NAMES)

        for table in tables:
            for row in table.to_pylist():
                if not started or row["conv_id"] != current:
                    if started:
                        yield end()
                    current, report, state, undeleted, started = row["conv_id"], Report(), START, 0, True
                codes, path = codes_of(row), row["paths"][state]
                report.turns(row["turns"], codes)
                report.path(path, list(zip(row["roles"], row["texts"])), state)
                undeleted += _undeleted(path, codes)
                state = row["lasts"][state]
        if started:
            yield end()

    grids = marked.mapInArrow(measured, "conv_id long, part long, seg long, costs array<double>")
    order = [F.desc("part"), F.desc("seg")]
    behind = grids.repartition("conv_id").sortWithinPartitions("conv_id", *order).mapInArrow(
        backward, "part long, seg long, behind array<double>"
    )
    found = marked.join(shared_table(behind, "behind"), at).mapInArrow(
        searched, "part long, seg long, paths array<string>, lasts array<long>"
    )
    both = marked.join(shared_table(found, "paths"), at)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", *at).mapInArrow(together, OUT)


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of each damaged conversation."""
    order = [
        "conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64), F.xxhash64("role", "text"),
        # Repeated rows, which are alike, may lie in several tasks.
        "nth",
    ]
    ready = damaged(rows).withColumn("nth", F.monotonically_increasing_id())
    ranged = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = shared_table(ranged.drop("nth").mapInArrow(lambda tables: _pieces(tables, segment), f"{OUT}, {PIECE}"), "conversations")
    whole = pieces.where("part is null").select(*NAMES)
    return whole.unionByName(_open(pieces.where("part is not null")))
