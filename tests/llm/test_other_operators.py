"""Pages, vectors, components, the field itself and the pipeline."""

from __future__ import annotations

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackquarry.llm import components, crf, embedding_dedup, html_extract, url_filter

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var x='<p>no</p>';</script></head><body>"
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>More</a></ul></nav><div class=ad>Buy now</div>"
    "<article><h1>A title &amp; more</h1><p>First  paragraph of<b> this</b> text.<p>Second&nbsp;one, with words."
    "<div class='comments'><p>nice post</p></div></article><footer>&copy; us</footer>"
)


def test_leaf_blocks_know_their_ancestors():
    found = html_extract.blocks(PAGE)
    assert [block[0] for block in found if block[3]] == ["A title & more", "First paragraph of this text.", "Second one, with words."]
    assert "Home" in [block[0] for block in found] and not any("no" == block[0] for block in found)
    assert html_extract.blocks(None) == html_extract.blocks("") == html_extract.blocks("<p></p>") == []
    assert html_extract.blocks("</div>a < b<script>x")[0][0] == "a < b"


def test_extraction_learns_other_layouts(spark):
    draw = random.Random(4)

    def words(n):
        return " ".join(draw.choice(["alon", "besti", "corun", "der", "ein"]) for _ in range(n)).capitalize() + "."

    rows, truth = [], {}
    for k in range(120):
        parts = [words(draw.randint(8, 40)) for _ in range(draw.randint(2, 6))]
        body = "<h1>{}</h1>".format(words(5)) + "".join(f"<p>{part}</p>" for part in parts)
        rows.append((k, f"http://x/{k}", f"<html><nav><a href=/>{words(2)}</a></nav><div class=ad>{words(4)}</div>"
                        f"<article>{body}</article><footer>{words(5)}</footer></html>", 1))
    other = [words(30), words(25)]
    truth[500] = " ".join(other)
    rows.append((500, "u", f"<body><div class=menu><a href=/>{words(2)}</a></div><main><p>{other[0]}</p><p>{other[1]}</p></main>"
                           f"<div class=comments><p>{words(6)}</p></div></body>", 1))
    rows += [(600, None, None, 1), (601, "u", "", 1), (602, "u", "<p>" + "x " * 200000 + "</p>", 1), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_extract.extract(pages).collect()
    assert len(found) == len(rows)
    texts = {row["page_id"]: row["text"] for row in found}
    assert texts[500] == truth[500]
    assert texts[600] == texts[601] == "" and all(row["n_chars"] == len(row["text"]) for row in found)
    assert html_extract.extract(pages.where("false")).count() == 0


def test_urls(spark):
    urls = [f"https://www.{a}.{b}/{c}/{k}?q" for k in range(12) for a in ("aon", "bun") for b in ("example.net", "example.com", "x.org") for c in ("en", "de", "fr")]
    urls += [None, "", "no-scheme/x", "http://", "HTTP://NET", "a://net/", "a://Sub.NET/en/#x", "a://example.net/en/x", "a://xnet/", "a://É.org/fr/?/", "x" * 100_000]
    pages = spark.createDataFrame([(k, url, 1.0) for k, url in enumerate([*urls, *urls[-3:]])], "page_id long, url string, score double")
    rows = {row["page_id"]: row for row in url_filter.judge(pages).collect()}
    at = {url: rows[k] for k, url in enumerate(urls)}
    assert (at[None]["host"], at[None]["path"], at[None]["rule"]) == ("", "", None) == (at["no-scheme/x"]["host"], "", None)
    assert (at["a://net/"]["rule"], at["a://net/"]["verdict"]) == ("net/", "block")
    assert at["HTTP://NET"]["host"] == "net" and at["HTTP://NET"]["rule"] is None
    assert (at["a://Sub.NET/en/#x"]["host"], at["a://Sub.NET/en/#x"]["rule"]) == ("sub.net", "net/")
    assert (at["a://example.net/en/x"]["rule"], at["a://example.net/en/x"]["verdict"]) == ("example.net/en/", "allow")
    assert at["a://xnet/"]["rule"] is None and at["a://É.org/fr/?/"]["rule"] == "org/fr/" and at["a://É.org/fr/?/"]["host"] == "É.org"
    assert at["https://www.aon.x.org/en/0?q"]["verdict"] == "allow" and at["https://www.aon.example.com/en/0?q"]["verdict"] == "block"
    assert len(rows) == pages.count() and {row["verdict"] for row in rows.values()} == {"allow", "block"}
    assert url_filter.judge(pages.where("false")).count() == 0


def _gram_counts(texts):
    counts = collections.Counter()
    for text in texts:
        padded = [None] * 5 + [*text.encode(), "end"]
        for k in range(5, len(padded)):
            for order in range(6):
                counts[tuple(padded[k - order : k]), padded[k]] += 1
                counts[tuple(padded[k - order : k])] += 1
    return counts


def _score(text, rejected, accepted):
    padded, total = [None] * 5 + [*text.encode(), "end"], 0.0
    for k in range(5, len(padded)):
        for counts, sign in ((rejected, -1), (accepted, 1)):
            chance = 1 / 257
            for order in range(6):
                context = tuple(padded[k - order : k])
                chance = (counts[context, padded[k]] + 4 * chance) / (counts[context] + 4)
            total += sign * math.log(chance)
    return total / (len(padded) - 5)


def test_url_models_count_every_gram_of_its_own(spark):
    draw = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789éß"

    def slug():
        return "".join(draw.choice(letters) for _ in range(60))

    # Distinct grams of orders 4 and 5 beyond 524,288; then URLs of no rule.
    ruled = [f"http://{slug()}.{('net', 'example.net')[k % 2]}/en/{slug()}" for k in range(4500)]
    free = [f"http://x.com/{slug()}" for _ in range(20)] + ["http://y.com/en/" + url[-30:] for url in ruled[:20]]
    pages = spark.createDataFrame(list(enumerate([*ruled, *free])), "page_id long, url string")
    rows = {row["page_id"]: row for row in url_filter.judge(pages).collect()}
    assert len(rows) == pages.count()
    classes = {"allow": [], "block": []}
    for k in range(len(ruled)):
        classes[rows[k]["verdict"]].append(ruled[k])
    assert min(map(len, classes.values())) > 1000
    rejected, accepted = _gram_counts(classes["block"]), _gram_counts(classes["allow"])
    for k in [*range(0, 4500, 500), *range(4500, len(rows))]:
        assert math.isclose(rows[k]["score"], _score([*ruled, *free][k], rejected, accepted), rel_tol=1e-9, abs_tol=1e-12)


def test_url_models_read_the_whole_url(spark):
    draw = random.Random(9)
    free = ["http://x.com/a?q=casino-win", "http://x.com/a?q=garden-tea", "http://x.com/a#free-bets", "http://x.com/a#garden",
            "x.com/casino-win", "x.com/garden-tea", "", None]
    ruled = [
        f"http://{draw.choice('abc')}.{host}/en/{k}{draw.choice('?#')}{draw.choice(words)}"
        for k in range(300)
        for host, words in (("net", ["q=casino-win", "free-bets"]), ("example.net", ["q=garden-tea", "garden"]))
    ]
    pages = spark.createDataFrame(list(enumerate([*ruled, *free])), "page_id long, url string")
    rows = {row["page_id"]: row for row in url_filter.judge(pages).collect()}
    found = {url: rows[len(ruled) + k] for k, url in enumerate(free)}
    assert [found[url]["verdict"] for url in free[:6]] == ["block", "allow"] * 3
    assert found[""]["score"] == found[None]["score"] == 0 and found[""]["verdict"] == found[None]["verdict"]
    assert all(row["rule"] is None for row in found.values())


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(6)
    centres = draw.standard_normal((40, 16))
    rows = []
    for k in range(900):
        base = centres[k % 40] if k % 3 else centres[0]
        rows.append((k, [float(x) for x in base + 0.12 * draw.standard_normal(16)], k % 4 if k % 3 else 1))
    rows += [(900, rows[0][1], 1), (901, rows[0][1], 2), (902, None, 1), (903, [0.0] * 16, 1), (904, rows[0][1], None)]
    rows += [(905, [float("nan")] * 16, 1), (906, [None] * 16, 1), (907, [], 1), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1), rows[0]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("x"))
    found = embedding_dedup.group(vectors).collect()
    sound = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    links: dict = {}
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) for r in sound]
    for a, b in itertools.combinations(range(len(sound)), 2):
        if sound[a][2] == sound[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    root = {k: sound[k][0] for k in range(len(sound))}
    for _ in range(50):
        for a, others in links.items():
            root[a] = min(root[a], *(root[b] for b in others))
    total = sum(map(len, links.values()))
    assert total - sum(row["n_links"] for row in found) <= 0.01 * total
    ids = {row["vec_id"]: row for row in found}
    assert sum(ids[sound[k][0]]["component_id"] != root[k] for k in root) <= 5
    assert all(ids[k]["n_links"] == 0 and ids[k]["kept"] for k in (901, 902, 903, 904, 905, 906, 907))
    assert ids[909]["component_id"] == 908 and len(found) == len(rows)
    assert embedding_dedup.group(vectors.where("false")).count() == 0


def test_components_of_long_paths(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    links = list(zip(order, order[1:])) + [(1000, 1001), (1001, 1002), (7, 7)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(1, 200)) and found[1002] == found[1001] == 1000


def _paths(chain, scores):
    n, labels = scores.shape
    for path in itertools.product(range(labels), repeat=n):
        value = chain.first[path[0]] + scores[0, path[0]]
        value += sum(chain.moves[path[t - 1], path[t]] + scores[t, path[t]] for t in range(1, n))
        yield path, value


def test_field_against_all_paths():
    draw = np.random.default_rng(8)
    chain = crf.Chain(draw.standard_normal((4, 3)), draw.standard_normal((3, 3)), draw.standard_normal(3))
    lengths = np.array([3, 1, 5, 2])
    features = draw.standard_normal((lengths.sum(), 4))
    scores = chain.scores(features)
    labels, likely = crf.viterbi(chain, scores, lengths), crf.marginals(chain, scores, lengths)
    end = 0
    for n in lengths:
        own = list(_paths(chain, scores[end : end + n]))
        assert tuple(labels[end : end + n]) == max(own, key=lambda x: x[1])[0]
        weights = np.exp([value for _, value in own])
        for t in range(n):
            for label in range(3):
                share = weights[[path[t] == label for path, _ in own]].sum() / weights.sum()
                assert likely[end + t, label] == pytest.approx(share)
        end += n
    assert len(crf.viterbi(chain, scores[:0], lengths[:0])) == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(9)
    rows, marks = [], []
    for k in range(240):
        words = [draw.choice(["alon", "besti", "corun", "der", "fon", "gir"]) + str(draw.choice("abc")) for _ in range(80)]
        good = k % 6 > 0
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        marks.append((k, int(good), 0))
    rows.append((1000, rows[1][1], "en", "s1", rows[1][4]))
    rows.append((1001, 'Plain words and token = "0123456789abcdef0123" here, and some more.', "en", "s2", 60))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    ids = {row["doc_id"] for row in kept.select("doc_id").collect()}
    assert ids >= {k for k in range(240) if k % 6} and not ids & {k for k in range(240) if k % 6 == 0}
    single = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    assert 1000 not in {row["doc_id"] for row in single.select("doc_id").collect()} and single.columns == docs.columns
    clean = corpus_pipeline.redact_secrets(spark, single, str(tmp_path))
    assert not clean.where(F.col("text").contains("0123456789abcdef")).count() and clean.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {row["doc_id"] for row in out.collect()} <= ids - {1000} and out.count() > 0
