"""Repair of conversations against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from stackquarry.llm import repair

SOUND = re.compile(r"(s?(ua)+)?")


def brute(turns):
    """Cheapest cost and first initials over (initial, fault), by uniform-cost search over
    whole states with the initials as the tie-break."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, path, at, roles = heapq.heappop(heap)
        if at == len(turns) and SOUND.fullmatch(roles):
            return cost, path
        if (cost, path, at, roles) in seen:
            continue
        seen.add((cost, path, at, roles))
        if not path.endswith("II"):
            for r in "ua":
                if SOUND.fullmatch(roles + r) or SOUND.fullmatch(roles + r + "a"):
                    heapq.heappush(heap, (cost + 2, path + "I", at, roles + r))
        if at < len(turns):
            initial, name = turns[at]
            heapq.heappush(heap, (cost + 3, path + "D", at + 1, roles))
            if name in (None, "truncated"):
                more = cost + (name == "truncated")
                for r, rise, edit in [(initial, 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                    if r in ("s", "u", "a") and any(SOUND.fullmatch(roles + r + end) for end in ("", "a", "ua")):
                        heapq.heappush(heap, (more + rise, path + edit, at + 1, roles + r))


def some_turns(draw, n):
    return [(draw.choice(["s", "u", "a", "u", "a", "t", ""]), draw.choice([None, None, None, "truncated", "blank", "duplicate"])) for _ in range(n)]


def test_search_finds_the_first_cheapest_path():
    draw = random.Random(12)
    cases = [some_turns(draw, draw.randint(0, 6)) for _ in range(150)]
    cases += [[(r, None) for r in roles] for n in range(5) for roles in itertools.product("sua", repeat=n)]
    for turns in cases:
        cost, path, last = repair.search(turns)
        assert (cost, path + "I" * (repair.ENDS[last] // 2)) == brute(turns), turns


def test_segments_give_the_path_of_the_whole():
    draw = random.Random(3)
    for _ in range(60):
        turns = some_turns(draw, 30)
        cuts = [0, *sorted(draw.sample(range(31), 4)), 30]
        parts = [turns[a:b] for a, b in zip(cuts, cuts[1:])]
        behind = [repair.ENDS]
        for part in reversed(parts):
            grid = repair.costs(part)
            behind.append([min(grid[a][b] + behind[-1][b] for b in range(4)) for a in range(4)])
        state, paths = repair.START, []
        for part, ends in zip(parts, reversed(behind[:-1])):
            _, path, state = repair.search(part, state, ends)
            paths.append(path)
        cost, path, last = repair.search(turns)
        assert behind[-1][repair.START] == cost and ("".join(paths), state) == (path, last)


def expected(rows):
    """The contract, row by row."""
    groups = {}
    for conv_id, turn, role, text in rows:
        own = groups.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen = [], set()
        for _, role, text in own:
            core = text.strip(" \t\n\v\f\r")
            name = "blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role[:1], name))
        numbers = {r[0] for r in own if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv_id] = (gaps, *(sum(t[1] == f for t in turns) for f in repair.FAULTS), illegal, turns, own)
    return out


def check(found, rows):
    wanted = expected(rows)
    assert sorted(str(r["conv_id"]) for r in found) == sorted(map(str, wanted))
    for row in found:
        *counts, turns, own = wanted[row["conv_id"]]
        assert [row[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal")] == counts
        cost, path, last = repair.search(turns)
        path += "I" * (repair.ENDS[last] // 2)
        assert (row["cost"], row["audit"]) == (cost, path)
        lines, at, roles = [], 0, ""
        for edit in path:
            role, text = "", ""
            if edit != "I":
                _, role, text = own[at]
                at += 1
            if edit in "IR":
                role = "assistant" if roles.endswith("u") else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                roles += role[:1]
        assert SOUND.fullmatch(roles)
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("segment", [repair.SEGMENT, 3])
def test_repair(spark, segment):
    draw = random.Random(7)
    texts = ["Yes.", "no", "Why?", " ", "", "ok!\n", None, "é" * 50 + ".", "Long text. " * 40, " "]
    rows = [
        (c, t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), draw.choice(texts))
        for c in range(120) for t in range(draw.randint(1, 9))
    ]
    rows += [(500, t, ["user", "assistant"][t % 2], f"Turn {t // 3}.") for t in range(400)]
    rows += [(None, 1, "user", "Hi."), (None, None, "system", "Be kind."), (None, None, None, None)]
    rows += [(600, 4, "user", "Same.")] * 40 + [(601, None, "user", "x.")] * 2 + [(602, k * 5, "assistant", "x" * 100_000) for k in range(3)]
    rows += [(700, t, "user", "a.") for t in range(30) if zlib.crc32(f"700:{t}".encode()) % 20 == 0] or [(700, 0, "user", "a.")]
    frame = spark.createDataFrame(
        [(*row, 1, "x") for row in rows], "conv_id int, turn int, role string, text string, part int, kind string"
    )
    check(repair.repair(frame, segment).collect(), rows)


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    gone = next(t for t in range(999) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = repair.repair(spark.createDataFrame([(1, gone, "user", "Hi.")], schema)).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
