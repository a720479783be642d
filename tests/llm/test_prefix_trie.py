"""The prefix trie against all prefixes of all conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from stackquarry.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[child] for child in below) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[child] for child in below)
        ends = ",".join(str(c) for c in sorted(members[node]) if rebuilt[c] == node)
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def some_rows():
    draw = random.Random(13)
    texts = ["a b", "c", "", None, " d\te ", "é f"]
    rows = [
        (c, t if draw.random() < 0.95 else None, draw.choice(["user", "assistant", None]), draw.choice(texts))
        for c in range(300) if c % 7 for t in range(draw.randint(1, 6))
    ]
    rows += [(1000 + k, t, "user", f"turn {t}") for k in range(25) for t in range(60)]
    rows += [(2000 + k, t, "user", f"turn {t if t < 30 + k else -k}") for k in range(9) for t in range(50)]
    return rows + [(None, 1, "user", "x"), (3000, 1, "user", "x" * 50_000), (3001, 1, None, None), (-7, 1, "user", "neg")] + rows[:5]


@pytest.mark.parametrize("segment, most", [(prefix_trie.SEGMENT, prefix_trie.HELD), (7, 20)])
def test_trie(spark, segment, most):
    rows = some_rows()
    wanted = brute([row for row in rows if row[0] != -7])
    frame = spark.createDataFrame([(*row, 1, "x") for row in rows if row[0] != -7], "conv_id int, turn int, role string, text string, depth int, a string")
    got = sorted((tuple(row) for row in prefix_trie.trie(frame, segment, most).collect()), key=str)
    assert got == wanted


def test_negative_ids_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    (root, *_) = sorted(prefix_trie.trie(spark.createDataFrame([(-7, 1, "user", "x"), (-21, 1, "user", "y")], schema)).collect(), key=lambda r: r["depth"])
    assert (root["conv_id"], root["depth"], root["n_convs"], root["parent_conv_id"]) == (-21, 0, 2, None)


def test_exit_nodes_and_handles():
    draw = random.Random(1)
    trie = prefix_trie.Trie()
    for k in range(400):
        turns = [draw.randint(0, 2) for _ in range(draw.randint(0, 12))]
        digests = [0]
        for depth, turn in enumerate(turns):
            digests.append(digests[-1] ^ hash((depth, turn, "x")) & (1 << 128) - 1)
        trie.insert(0, digests, [1] * len(turns), [k], True)
        ((root, handles),) = trie.roots.values()
        for digest, node in handles.items():
            assert node.digest(prefix_trie.fattest(node.top, node.end)) == digest
    assert [prefix_trie.fattest(*pair) for pair in [(0, 5), (4, 7), (5, 6), (6, 7), (0, 1), (7, 9)]] == [4, 6, 6, 7, 1, 8]
    assert root.weight == 0 or root.weight > 0
    rows = list(trie.rows())
    assert rows[0][7] == 400 and len({row[:3] for row in rows}) == len(rows)
