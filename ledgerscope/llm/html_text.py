"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  Each block has its number of
words and its share of words in links, the words and link share of the up to
``NEAR`` blocks before and after it that stand with it (in the same article or
section, on the same side of any furniture), whether it stands in page
furniture, and whether it stands in the article.  A decision tree trained here
on ``TAUGHT`` keeps the blocks of the article: long ones for what they are,
short ones by their neighbours.

An element is furniture by its tag, or if its class, id or role is a whole name
of some; but an element that holds more than three quarters of the page's words outside
of links is none, whatever it is called: forms and notices around whole pages
hide no article.  Where the tree keeps less than half of the words outside of
furniture and links, all blocks there that aren't mostly links are the text.

Character references are decoded, white space inside a block (line breaks too)
becomes one space, and kept blocks are joined in page order by one newline.
Defined results: a null or empty page has an empty text; a tag that the page's
end cuts off is no text; tags that are never closed end with what encloses
them; scripts, styles, comments and the head are never text.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg(?![^>]*/\s*>)|iframe|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<with>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<\Z|<[a-zA-Z][^<]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags and names that mark page furniture, tags that mark the article, tags inside a line.
FURNITURE_TAGS = frozenset("nav header footer aside form head menu dialog button fieldset".split())
FURNITURE = (
    r"nav|navbar|navigation|menu|header|footer|sidebar|aside|ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|notice|notices|popup|modal"
    r"|newsletter|subscribe|subscription|social|share|sharing|related|recommended|comments?|respond|replies|reply|breadcrumbs?|pagination|pager|widget|login|search|contentinfo|complementary"
)
#: Words that only say which piece of furniture a name means; any other word in it may say that there is none.
PIECE = "site|page|top|bottom|main|primary|secondary|global|user|article|post|posts|entry|story|stories|area|list|section|box|block|bar|items?|links?|buttons?|icons?|form|text|title|body|content|slot|unit"
FURNITURE_NAME = re.compile(rf"(?:(?:{PIECE})[_-]+)*(?:{FURNITURE})(?:[_-]+(?:{FURNITURE}|{PIECE}))*", re.I)
#: Tags that hold the article whatever their names say of the page around it.
NEVER_FURNITURE = frozenset("html body main article".split())
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|main|post|entry|story|content|body)(?:$|[\s_-])", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HOLDERS = frozenset("html body div section article main ul ol dl table tbody thead tr td th details figure blockquote".split()) | FURNITURE_TAGS

#: Tags that part a block's neighbours from others.
SECTIONS = frozenset("article main section".split())
#: Blocks before and after that are a block's neighbours.
NEAR = 4
#: Labelled blocks: words, link share, the same of the neighbours before and after, in furniture, in the article, kept.
TAUGHT = (
    (12, 0.0, 0, 0.0, 140, 0.0, 0, 1, 1),
    (40, 0.0, 12, 0.0, 90, 0.0, 0, 1, 1),
    (1, 0.0, 40, 0.0, 1, 0.0, 0, 1, 1),
    (1, 0.0, 1, 0.0, 60, 0.0, 0, 1, 1),
    (3, 0.0, 90, 0.05, 0, 0.0, 0, 1, 1),
    (150, 0.1, 5, 0.0, 1, 1.0, 0, 1, 1),
    (25, 0.4, 60, 0.0, 80, 0.0, 0, 1, 1),
    (8, 0.0, 3, 1.0, 8, 0.0, 0, 1, 1),
    (700, 0.0, 5, 1.0, 12, 0.0, 0, 1, 1),
    (2, 0.0, 9, 0.0, 0, 0.0, 0, 1, 1),
    (2, 0.0, 0, 0.0, 9, 0.0, 0, 1, 1),
    (4, 0.0, 3, 0.0, 20, 0.0, 0, 1, 1),
    (3, 0.0, 20, 0.0, 4, 0.0, 0, 1, 1),
    (5, 0.0, 7, 0.0, 7, 0.0, 0, 1, 1),
    (6, 0.0, 0, 0.0, 8, 0.0, 0, 1, 1),
    (9, 0.0, 0, 0.0, 3, 0.0, 0, 1, 1),
    (9, 0.0, 3, 0.0, 0, 0.0, 0, 1, 1),
    (8, 0.8, 50, 0.0, 60, 0.0, 0, 1, 1),
    (12, 0.7, 90, 0.1, 70, 0.0, 0, 1, 1),
    (3, 0.0, 0, 0.0, 2, 0.0, 0, 1, 1),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 1, 1),
    (1, 0.0, 2, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 1, 0.0, 0, 0.0, 0, 1, 1),
    (1, 0.0, 0, 0.0, 1, 0.0, 0, 1, 1),
    (5, 0.0, 60, 0.0, 0, 0.0, 0, 1, 1),
    (7, 0.0, 113, 0.0, 0, 0.0, 0, 1, 1),
    (8, 0.0, 12, 0.0, 0, 0.0, 0, 1, 1),
    (4, 0.0, 3, 0.0, 0, 0.0, 0, 1, 1),
    (6, 0.0, 2, 0.0, 0, 0.0, 0, 1, 1),
    (6, 0.0, 0, 0.0, 4, 0.0, 0, 1, 1),
    (8, 0.0, 1, 0.0, 2, 0.0, 0, 1, 1),
    (8, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0),
    (6, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0),
    (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0),
    (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0),
    (6, 1.0, 60, 0.0, 5, 1.0, 0, 1, 0),
    (4, 1.0, 5, 1.0, 5, 1.0, 0, 1, 0),
    (9, 0.9, 80, 0.0, 0, 0.0, 0, 1, 0),
    (1, 1.0, 0, 0.0, 3, 1.0, 1, 0, 0),
    (1, 1.0, 3, 1.0, 3, 1.0, 1, 0, 0),
    (9, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0),
    (30, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0),
    (25, 0.1, 150, 0.0, 0, 0.0, 1, 0, 0),
    (80, 0.0, 90, 0.0, 60, 0.0, 1, 1, 0),
    (45, 0.0, 20, 0.0, 50, 0.0, 1, 1, 0),
    (2, 0.0, 3, 0.0, 4, 0.0, 1, 0, 0),
    (200, 0.0, 40, 0.0, 40, 0.0, 1, 0, 0),
    (20, 0.0, 1, 1.0, 90, 0.0, 1, 0, 0),
    (5, 0.0, 3, 1.0, 60, 0.0, 1, 0, 0),
    (2, 1.0, 1, 1.0, 70, 0.0, 1, 1, 0),
    (60, 0.0, 5, 0.0, 80, 0.0, 1, 0, 0),
    (3, 0.0, 70, 0.0, 50, 0.0, 1, 1, 0),
    (60, 0.0, 8, 0.0, 70, 0.02, 0, 0, 1),
    (90, 0.1, 60, 0.0, 5, 0.5, 0, 0, 1),
    (35, 0.05, 3, 1.0, 80, 0.0, 0, 0, 1),
    (20, 0.0, 90, 0.0, 60, 0.0, 0, 0, 1),
    (120, 0.2, 2, 0.0, 2, 1.0, 0, 0, 1),
    (3, 0.0, 60, 0.0, 80, 0.0, 0, 0, 1),
    (6, 0.0, 40, 0.0, 90, 0.0, 0, 0, 1),
    (2, 0.0, 120, 0.05, 45, 0.0, 0, 0, 1),
    (1, 0.0, 35, 0.0, 30, 0.1, 0, 0, 1),
    (7, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1),
    (4, 0.0, 2, 1.0, 110, 0.0, 0, 0, 1),
    (5, 0.0, 30, 0.0, 50, 0.0, 0, 0, 1),
    (6, 0.0, 0, 0.0, 95, 0.0, 0, 0, 1),
    (40, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1),
    (25, 0.0, 60, 0.0, 1, 0.0, 0, 0, 1),
    (30, 0.05, 1, 0.0, 3, 0.0, 0, 0, 1),
    (55, 0.1, 5, 0.0, 0, 0.0, 0, 0, 1),
    (18, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1),
    (22, 0.0, 30, 0.0, 6, 1.0, 0, 0, 1),
    (14, 0.0, 35, 0.0, 28, 0.0, 0, 0, 1),
    (45, 0.3, 2, 1.0, 3, 1.0, 0, 0, 1),
    (4, 1.0, 3, 1.0, 60, 0.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 80, 0.0, 0, 0, 0),
    (6, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0),
    (3, 1.0, 0, 0.0, 100, 0.0, 0, 0, 0),
    (8, 0.9, 5, 1.0, 90, 0.0, 0, 0, 0),
    (12, 0.8, 60, 0.0, 50, 0.0, 0, 0, 0),
    (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0),
    (6, 0.0, 3, 0.5, 2, 0.0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0),
    (4, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0),
    (6, 0.0, 120, 0.0, 4, 1.0, 0, 0, 0),
    (3, 0.0, 50, 0.0, 6, 0.9, 0, 0, 0),
    (3, 1.0, 4, 1.0, 3, 1.0, 0, 0, 0),
    (10, 0.8, 3, 1.0, 4, 0.9, 0, 0, 0),
    (40, 0.9, 30, 0.9, 20, 1.0, 0, 0, 0),
    (7, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0),
    (2, 0.0, 6, 0.5, 0, 0.0, 0, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10):
    """A decision tree by Gini impurity: (feature, threshold, low, high) or the label of a leaf."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1] - 1, -1, -1):  # of equal splits that by the later feature
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t, low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t, low = best
    return f, float(t), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@functools.cache
def tree(taught=TAUGHT):
    table = np.array(taught, float)
    return grow(table[:, :-1], table[:, -1])


def kept(features) -> bool:
    node = tree()
    while not isinstance(node, int):
        f, t, low, high = node
        node = low if features[f] <= t else high
    return bool(node)


def blocks_of(page: str) -> list[tuple[str, int, int, tuple[int, ...], bool, int]]:
    """(text, words, words in links, furniture elements around it, in the article, article or section around it) of the page's blocks."""
    out, parts, linked = [], [], 0
    holders: list[tuple[str, tuple[int, ...], bool, int]] = []
    furniture, article, section = (), False, 0
    links = number = 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, len(text.split(" ")), linked, furniture, article, section))
            parts.clear()
        linked = 0

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text.split())
            continue
        tag = m["tag"]
        if not tag:
            if m["raw"]:
                close() if m["raw"].lower() in ("title", "textarea", "select", "iframe") else None
            continue
        tag = tag.lower()
        if tag in INLINE or tag == "svg":
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if m["end"] else 1
            continue
        close()
        links = 0
        if tag not in HOLDERS:
            continue
        if m["end"]:
            for i in range(len(holders) - 1, -1, -1):
                if holders[i][0] == tag:
                    del holders[i:]
                    break
        elif not m["with"].rstrip().endswith("/"):
            number += 1
            names = " ".join(a or b or c for a, b, c in NAMED.findall(m["with"])) if m["with"] else ""
            named = tag in FURNITURE_TAGS or tag not in NEVER_FURNITURE and any(map(FURNITURE_NAME.fullmatch, names.split()))
            holders.append((tag, (*furniture, number) if named else furniture, article or tag in ("article", "main") or bool(ARTICLE.search(names)), number if tag in SECTIONS or named else section))
        furniture, article, section = holders[-1][1:] if holders else ((), False, 0)
    close()
    return out


def features(found: list) -> list[tuple]:
    """What the tree sees of each block."""
    inside: dict[int, int] = {}
    total = 0
    for _, words, links, around, _, _ in found:
        total += words - links
        for number in around:
            inside[number] = inside.get(number, 0) + words - links
    furniture = [tuple(n for n in b[3] if 4 * inside[n] <= 3 * total) for b in found]
    sums = [(0, 0)]
    for b in found:
        sums.append((sums[-1][0] + b[1], sums[-1][1] + b[2]))
    place = [(b[5], around) for b, around in zip(found, furniture, strict=True)]

    def near(low: int, high: int) -> tuple[int, float]:
        words, links = (sums[high][k] - sums[low][k] for k in (0, 1))
        return words, links / words if words else 0.0

    seen = []
    for i, b in enumerate(found):
        low = high = i
        while low > 0 and i - low < NEAR and place[low - 1] == place[i]:
            low -= 1
        while high + 1 < len(found) and high - i < NEAR and place[high + 1] == place[i]:
            high += 1
        seen.append((b[1], b[2] / b[1], *near(low, i), *near(i + 1, high + 1), bool(furniture[i]), b[4]))
    return seen


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    seen = features(found)
    chosen = [kept(f) for f in seen]
    plain = [not f[6] and f[1] < 0.5 for f in seen]
    words = lambda those: sum(b[1] for b, x in zip(found, those, strict=True) if x)
    text = chosen if 2 * words(chosen) >= words(plain) else plain
    return "\n".join(b[0] for b, x in zip(found, text, strict=True) if x)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """``pages`` with ``text`` (empty if there is none) in place of ``source``, and ``n_chars``."""
    df = small_batches(pages).drop("text", "n_chars")
    columns = df.columns
    at = columns.index(source)
    others = [i for i in range(len(columns)) if i != at]

    def mapper(batches):
        for batch in batches:
            made = pa.array([main_text(p) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), made], names=[*(columns[i] for i in others), "text"])

    schema = "".join(f"`{columns[i]}` {df.schema[columns[i]].dataType.simpleString()}, " for i in others)
    return df.mapInArrow(mapper, f"{schema}text string").withColumn("n_chars", F.length("text").cast("long"))
