"""Benchmark passages against a brute-force search, by both ways."""

from __future__ import annotations

import random
import re

import pytest

from stackquarry.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own = words(text)
    hit, found = set(), set()
    for name, item in items:
        parts = words(item)
        n = min(10, len(parts))
        for k in range(len(parts) - n + 1) if n else ():
            for at in range(len(own) - n + 1):
                if own[at : at + n] == parts[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(name)
    return len(own), len(hit), sorted(str(name) for name in found if name is not None)


def cases():
    draw = random.Random(11)
    vocabulary = ["ab", "c", "Déf", "gh1", "i", "J", "ñ", "k" * 9000, "zz"]

    def some(n, sep=" "):
        return sep.join(draw.choice(vocabulary) for _ in range(n))

    items = [(k, some(draw.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for k in range(12)]
    items += [(20, items[3][1]), (20, items[4][1]), (None, "only null item"), (30, None), (31, ""), (32, "?!"), items[0]]
    items.append((40, "long passage " + some(30, ", ")))
    texts = [some(draw.randint(0, 40)) for _ in range(40)]
    texts += [some(5) + " -- " + item.upper().replace(" ", "\n- ") + some(4) for _, item in items if item]
    texts += [None, "", " \x00 ", "?", items[-1][1], "x " * 30000 + items[-1][1] + " y", "a an only null item b"]
    texts += ["gh1", "ab" * 2] + [texts[41]] * 30
    return items, texts


@pytest.mark.parametrize("small", [decontaminate.SMALL_BYTES, 0])
def test_contamination(spark, small):
    items, texts = cases()
    docs = spark.createDataFrame(
        [(k if k % 9 else None, text, "x", k) for k, text in enumerate(texts)], "doc_id int, text string, item_id string, items long"
    )
    benchmark = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = decontaminate.contamination(docs, benchmark, small=small).collect()
    wanted = sorted((str(k if k % 9 else None), *brute(text, items)) for k, text in enumerate(texts))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == wanted
    texts_of = {k: text for k, text in enumerate(texts) if k % 9}
    for row in got:
        if row["doc_id"] in texts_of:
            cut = [texts_of[row["doc_id"]][s["start"] : s["end"]] for s in row["spans"]]
            assert sum(len(words(part)) for part in cut) == row["n_hit"]


@pytest.mark.parametrize("small", [decontaminate.SMALL_BYTES, 0])
def test_empty_tables(spark, small):
    docs = spark.createDataFrame([(1, "a b c"), (1, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    none = decontaminate.contamination(docs, benchmark.where("false"), small=small).collect()
    assert sorted((r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in none) == [(0, 0, [], []), (3, 0, [], [])]
    assert decontaminate.contamination(docs.where("false"), benchmark, small=small).count() == 0
    (row,) = decontaminate.report(docs.where("text is not null"), benchmark).collect()
    assert (row["n_hit"], row["n_items"], row["contaminated"]) == (2, 1, True)
