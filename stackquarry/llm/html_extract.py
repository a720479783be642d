"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is read into leaf blocks: runs of text that no block-level tag interrupts, each with
the tags and class names of its ancestors. The field labels every block main or not by
ancestor features, features of its text and those of the blocks before and after it; the
best path by Viterbi decides. It is trained on a bounded sample of the pages: where a page
marks its article, the tags label its blocks, and the same blocks, set into other layouts
with other boilerplate around and inside them, are further labelled pages.

Defined results: null, empty or text-free html gives an empty text. Unclosed and unmatched
tags are read as browsers do: an end tag closes up to its start tag or is passed over.
Rows with equal html have equal texts. If no sampled page marks an article, every
layout is built around the sampled pages' own paragraphs. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackquarry.llm import crf

#: Bounds of the training sample: pages by the hash of their id, blocks of one page, and
#: layouts that one page is set into.
TRAIN_PAGES = 240
TRAIN_BLOCKS = 150
LAYOUTS = 3

EXTRACTED = "page_id long, url string, text string, n_chars long"

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = set("script style noscript template svg iframe object canvas head title select textarea".split())
RAW = set("script style title textarea noscript iframe template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)

#: Groups of tags and of name parts (class, id, role) whose presence among the ancestors
#: is a feature. A part fits if it begins with a word of five letters or more, or equals
#: a shorter one.
TAG_GROUPS = [
    "article main", "nav menu", "header", "footer", "aside", "form button fieldset", "li ul ol dl",
    "table", "h1 h2 h3 h4 h5 h6", "p", "blockquote pre figure", "section",
]
NAME_GROUPS = [
    "content article post entry story body text main",
    "nav menu navigation breadcrumb toc pager pagination",
    "header masthead topbar brand logo",
    "footer copyright legal contentinfo bottom",
    "sidebar aside widget rail complementary",
    "ad ads advert adslot banner sponsor promo",
    "cookie consent notice alert gdpr popup modal overlay warning",
    "comment reply replies discuss disqus respond",
    "form login signup search subscribe newsletter register",
    "related share social recommend more trending popular",
    "byline meta author date tags caption",
]
STOCK = re.compile(
    r"©|copyright|all rights|cookie|subscribe|sign in|log in|newsletter|advertis|sponsor|read more|share this|"
    r"leave a reply|privacy|terms of",
    re.IGNORECASE,
)
_TAG_BIT = {tag: 1 << k for k, tags in enumerate(TAG_GROUPS) for tag in tags.split()}
_NAME_BIT = {
    name: 1 << (k + len(TAG_GROUPS)) for k, names in enumerate(NAME_GROUPS) for name in names.split()
}
BITS = len(TAG_GROUPS) + len(NAME_GROUPS)
_ARTICLE = _TAG_BIT["article"]
#: Groups that name a part of the page; the others tell the kind of a block.
_PARTS = sum(1 << k for k in [*range(6), *range(len(TAG_GROUPS), BITS)])
_CONTENT = _ARTICLE | 1 << len(TAG_GROUPS)
_OTHER = sum(1 << k for k in range(1, 6)) | sum(1 << (k + len(TAG_GROUPS)) for k in range(1, 10))


def _bits(tag: str, attributes: str, known: dict[tuple[str, str], int]) -> int:
    key = (tag, attributes)
    if key not in known:
        bits = _TAG_BIT.get(tag, 0)
        for name, *values in ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                for part in NAME_PART.findall("".join(values)):
                    part = part.lower()
                    for n in range(len(part), 0, -1):
                        if n == len(part) or n >= 5:
                            bits |= _NAME_BIT.get(part[:n], 0)
        if len(known) > 10_000:
            known.clear()
        known[key] = bits
    return known[key]


#: Text, ancestor bits, share of linked text, label, bits of the nearest part of the page.
Block = tuple[str, int, float, int, int]


def blocks(page: str | None, known: dict | None = None) -> list[Block]:
    """The leaf blocks of a page in order. The label is that of the nearest ancestor with
    a ``data-label`` attribute; else whether an article holds the block and nothing else
    that the groups name as boilerplate does."""
    known = {} if known is None else known
    out: list[Block] = []
    stack: list[tuple[str, int, int, int | None, bool]] = []  # tag, bits, near, label, opaque
    bits, near, label, opaque, links = 0, 0, None, False, 0
    parts: list[str] = []
    linked = 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                marked = int(bool(bits & _ARTICLE) and not bits & _OTHER) if label is None else label
                out.append((text, bits, min(linked / len(text), 1.0), marked, near))
            parts.clear()
        linked = 0

    def leave(at: int) -> None:
        nonlocal bits, near, label, opaque, links
        links -= sum(element[0] == "a" for element in stack[at:])
        del stack[at:]
        _, bits, near, label, opaque = stack[-1] if stack else ("", 0, 0, None, False)

    page = page or ""
    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        text = page[at : found.start() if found else n]
        if text and not opaque:
            parts.append(text)
            linked += len(text) if links else 0
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag == "br" and not opaque:
            parts.append(" ")
        if tag not in INLINE:
            close_block()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
            continue
        if tag in VOID or found[3].endswith("/"):
            continue
        if tag not in INLINE:
            # A new block ends an open paragraph; a new item ends an open item.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] == tag == "li":
                    leave(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        own = _bits(tag, found[3], known)
        mark = re.search(r'data-label="([01])"', found[3])
        label = int(mark[1]) if mark else label
        bits, near, opaque = bits | own, own & _PARTS or near, opaque or tag in OPAQUE
        links += tag == "a"
        stack.append((tag, bits, near, label, opaque))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            leave(len(stack) - 1)
            at = end.end() if end else n
    close_block()
    return out


def _text_features(text: str, linked: float) -> tuple[float, ...]:
    n = len(text)
    words = text.count(" ") + 1
    return (
        np.log1p(words) / 5, words <= 2, words <= 8, linked, linked > 0.6,
        text[-1] in ".!?…", (text.count(",") + text.count(".")) / words,
        sum(map(str.isdigit, text[:200])) / min(n, 200), bool(STOCK.search(text[:400])), text[:1].isupper(),
    )


WIDTH = 2 * BITS + 10


def features(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all blocks, and the blocks of each page."""
    lengths = np.array([len(page) for page in pages], np.int64)
    flat = [block for page in pages for block in page]
    masks = np.array([block[1] for block in flat], np.int64)
    nearest = np.array([block[4] for block in flat], np.int64)
    shown = (np.stack([masks, nearest], axis=1)[:, :, None] >> np.arange(BITS)) & 1
    shown = shown.reshape(len(flat), 2 * BITS)
    text = np.array([_text_features(block[0], block[2]) for block in flat], float).reshape(len(flat), WIDTH - 2 * BITS)
    own = np.hstack([shown, text]) if flat else np.empty((0, WIDTH))
    before, after = np.zeros_like(own), np.zeros_like(own)
    page = np.repeat(np.arange(len(pages)), lengths)
    same = page[1:] == page[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    # Whether the page names its content at all tells what a block outside of it is.
    named = np.zeros(len(pages), bool)
    np.logical_or.at(named, page, masks & _CONTENT > 0)
    outside = masks & _CONTENT == 0
    bare = outside & (nearest == 0)
    whole = np.stack([outside & named[page], bare & ~named[page], bare & named[page]], axis=1)
    alike = np.zeros((len(own), 2))
    alike[1:, 0] = same & (masks[1:] == masks[:-1])
    alike[:-1, 1] = same & (masks[1:] == masks[:-1])
    return np.hstack([own, before, after, whole, alike, np.ones((len(own), 1))]), lengths


def layouts(page: list[Block], seed: int) -> list[str]:
    """Labelled pages: a page's own main blocks in other layouts, with boilerplate of its
    other blocks, before, behind and inside them. The layouts are fixed; the seed chooses."""
    draw = random.Random(seed)
    main = [block[0] for block in page if block[3]] or [block[0] for block in page if len(block[0]) > 80]
    other = [block[0] for block in page if not block[3]] or ["Home", "About us", "Contact"]
    if not main:
        return []

    def some(low: int, high: int) -> list[str]:
        return [entities.escape(draw.choice(other)) for _ in range(draw.randint(low, high))]

    def words(n: int) -> str:
        return entities.escape(" ".join(draw.choice(main).split()[:n]))

    def sentence() -> str:
        return entities.escape(draw.choice(main + other))

    def box(tag: str, name: str, inner: str) -> str:
        attribute = draw.choice(["class", "id"])
        return f'<{tag} {attribute}="{name}" data-label="0">{inner}</{tag}>' if name else f'<{tag} data-label="0">{inner}</{tag}>'

    def menu() -> str:
        items = "".join(f'<li><a href="/{k}">{words(draw.randint(1, 2))}</a></li>' for k in range(draw.randint(3, 8)))
        return box(*draw.choice([("nav", ""), ("div", "menu"), ("ul", "navigation"), ("div", "breadcrumb")]), f"<ul>{items}</ul>")

    def head() -> str:
        return box(*draw.choice([("header", ""), ("div", "header"), ("div", "masthead")]), f"<h2>{words(3)}</h2><p>{words(8)}</p>")

    def foot() -> str:
        return box(*draw.choice([("footer", ""), ("div", "footer"), ("div", "copyright")]), f"&copy; {words(2)} &middot; {sentence()}")

    def side() -> str:
        inner = "".join(f'<h3>{words(3)}</h3><p>{sentence()}</p><p><a href="#">{words(6)}</a></p>' for _ in range(draw.randint(1, 3)))
        return box(*draw.choice([("aside", ""), ("div", "sidebar"), ("div", "widget"), ("aside", "sidebar"), ("div", "related")]), inner)

    def advert() -> str:
        return box(*draw.choice([("div", "ad"), ("div", "advert"), ("div", "sponsored"), ("div", "ad-banner"), ("aside", "promo")]), sentence())

    def notice() -> str:
        return box(*draw.choice([("div", "cookie-notice"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("section", "gdpr-popup")]), f"<p>{sentence()}</p><button>{words(1)}</button>")

    def form() -> str:
        return box(*draw.choice([("form", ""), ("form", "search"), ("div", "newsletter"), ("div", "login-form")]), f"<label>{words(2)}</label><input name=q><p>{sentence()}</p><button>{words(1)}</button>")

    def comments() -> str:
        inner = "".join(f'<div class="{draw.choice(["comment", "reply", "c"])}"><p>{sentence()}</p></div>' for _ in range(draw.randint(1, 5)))
        return box(*draw.choice([("div", "comments"), ("section", "comments"), ("ol", "comment-list"), ("div", "discussion"), ("div", "replies")]), f"<h3>{words(2)}</h3>{inner}")

    pages = []
    for _ in range(LAYOUTS):
        shorter = draw.random() < 0.5
        kept = [" ".join(text.split()[: draw.randint(3, 40)]) if shorter else text for text in main]
        title, *rest = map(entities.escape, kept)
        heading = draw.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"])
        inner = [heading.format(" ".join(title.split()[: draw.randint(1, 12)]))]
        for text in rest or [title]:
            shape = draw.choice(["<p>{}</p>"] * 5 + ["<p>{}", "<div>{}</div>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<h3>{}</h3>"])
            inner.append(shape.format(text))
        for piece in (advert, side, form, notice):
            if draw.random() < 0.4:
                inner.insert(draw.randint(1, len(inner)), piece())
        if draw.random() < 0.4:
            inner.append(comments())
        opened, closed = draw.choice(
            [("<article{}>", "</article>"), ("<main{}>", "</main>"), ('<div class="content"{}>', "</div>"), ('<div class="post"{}>', "</div>"),
             ('<div id="article-body"{}>', "</div>"), ('<section class="story"{}>', "</section>"), ("<div{}>", "</div>"), ("<div><div{}>", "</div></div>"),
             ('<main{}><article class="entry">', "</article></main>")]
        )
        body = opened.format(' data-label="1"') + "".join(inner) + closed
        before = [piece() for piece in (notice, head, menu, advert, form) if draw.random() < 0.5]
        after = [piece() for piece in (comments, side, form, advert, menu, foot) if draw.random() < 0.5]
        if draw.random() < 0.5:
            draw.shuffle(before)
        pages.append(f'<html><body data-label="0">{"".join(before)}{body}{"".join(after)}</body></html>')
    return pages


def train(pages: DataFrame) -> crf.Chain | None:
    """The field, from a bounded sample of pages; None if it holds no block."""
    ids = pages.select(F.col("page_id").cast("bigint").alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(TRAIN_PAGES)
    chosen = pages.select(F.col("page_id").cast("bigint").alias("id"), "html").join(F.broadcast(ids), "id")

    def labelled(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for page_id, page in zip(table.column(0).to_pylist(), table.column(1).to_pylist()):
                own = blocks(page)[:TRAIN_BLOCKS]
                versions = [own] if any(block[3] for block in own) else []
                versions += [blocks(text)[: 2 * TRAIN_BLOCKS] for text in layouts(own, page_id)]
                values, lengths = features(versions)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(values), page_id)),
                        pa.array(np.repeat(np.arange(len(versions)), lengths)),
                        pa.array(np.concatenate([np.arange(k) for k in lengths]) if len(lengths) else np.empty(0, np.int64)),
                        pa.array([block[3] for version in versions for block in version], pa.int64()),
                        pa.array(values.astype(np.float32).tolist(), pa.list_(pa.float32())),
                    ],
                    names=["id", "version", "nth", "label", "features"],
                )

    got = chosen.select("id", "html").mapInArrow(
        labelled, "id long, version long, nth long, label long, features array<float>"
    ).toPandas().sort_values(["id", "version", "nth"], kind="stable")
    if not len(got):
        return None
    lengths = np.diff(np.append(np.flatnonzero(got["nth"].to_numpy() == 0), len(got)))
    return crf.train(np.stack(got["features"].to_numpy()).astype(float), got["label"].to_numpy(), lengths, 2, rounds=120)


def main_texts(pages: list[str | None], field: crf.Chain | None) -> list[str]:
    known: dict = {}
    read = [blocks(page, known) for page in pages]
    if field is None:
        return ["" for _ in pages]
    values, lengths = features(read)
    labels = crf.viterbi(field, field.scores(values), lengths) if len(values) else np.empty(0, np.int8)
    ends = np.cumsum(lengths).tolist()
    return [
        " ".join(block[0] for block, label in zip(page, labels[end - len(page) : end]) if label)
        for page, end in zip(read, ends)
    ]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    field = train(pages)

    def extracted(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for low in range(0, table.num_rows, 256):
                part = table.slice(low, 256)
                texts = main_texts(part.column("html").to_pylist(), field)
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(extracted, EXTRACTED)
