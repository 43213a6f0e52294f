"""One pass over a page's tags: links, job titles and client names, each found by where its element begins and ends.

The parser keeps, for each element, its number, the number after its last
descendant, and the stretch of text pieces inside it.  Lengths and words of any
element's text are then differences of running sums, a phrase is inside an
element if its place lies in the stretch, and what a container holds is a slice
of a list.  So a page takes time in proportion to its length, however deep its
elements stand in each other.

End tags close the nearest open element of their name and all inside it; end
tags without one are ignored; void elements hold nothing; text of scripts,
styles, templates and ruby notes is none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from ledgerscope import fixed_values as V

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link meta nextid param source spacer track wbr".split())
QUIET = frozenset(("script", "style", "template", "rt", "rp"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
HOLDERS, MARKED = frozenset(("section", "div", "article", "aside")), frozenset(("section", "div", "ul"))
NAMED = frozenset(("figcaption", "li", "span", "p"))
NO_PAGE = ("#", "mailto:", "tel:", "javascript:")
_CLIENTS = re.compile(V.CLIENT_SECTION, re.I)
_JUNK = re.compile(V.LOGO_JUNK, re.I)


class Page(HTMLParser):
    """A page's elements, in the order of their start tags."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.first: list[int] = []
        self.last: list[int] = []
        self.pieces: list[str] = []
        self._open: list[int] = []
        self._many: dict[str, int] = {}
        self._quiet = 0
        self.feed(html)
        self.close()
        while self._open:
            self._pop()
        self.chars, self.words = [0], [0]
        for piece in self.pieces:
            self.chars.append(self.chars[-1] + len(piece) + 1)
            self.words.append(self.words[-1] + piece.count(" ") + 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        number = len(self.tags)
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)} if attrs else {})
        self.parents.append(self._open[-1] if self._open else -1)
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        self.ends.append(number + 1)
        if tag not in VOID:
            self._open.append(number)
            self._many[tag] = self._many.get(tag, 0) + 1
            self._quiet += tag in QUIET

    def _pop(self) -> str:
        number = self._open.pop()
        tag = self.tags[number]
        self._many[tag] -= 1
        self._quiet -= tag in QUIET
        self.last[number], self.ends[number] = len(self.pieces), len(self.tags)
        return tag

    def handle_endtag(self, tag: str) -> None:
        if self._many.get(tag):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self._quiet and (words := data.split()):
            self.pieces.append(" ".join(words))

    def length(self, i: int) -> int:
        return max(0, self.chars[self.last[i]] - self.chars[self.first[i]] - 1)

    def text(self, i: int) -> str:
        return " ".join(self.pieces[self.first[i] : self.last[i]])


class Within:
    """Whether a phrase stands inside an element: the places where ``found`` finds one in all text, against the element's stretch."""

    def __init__(self, page: Page, pieces: list[str], found):
        self.page, self.at = page, [0]
        for piece in pieces:
            self.at.append(self.at[-1] + len(piece) + 1)
        self.places = sorted(found(" ".join(pieces)))

    def __call__(self, i: int) -> bool:
        begin, end = self.at[self.page.first[i]], self.at[self.page.last[i]] - 1
        at = bisect_left(self.places, (begin, 0))
        while at < len(self.places) and self.places[at][0] < end:
            if self.places[at][1] <= end:
                return True
            at += 1
        return False


def _places_of(words):
    def found(text: str) -> Iterator[tuple[int, int]]:
        for word in words:
            at = text.find(word)
            while at >= 0:
                yield at, at + len(word)
                at = text.find(word, at + 1)

    return found


def _client_places(text: str) -> Iterator[tuple[int, int]]:
    return ((m.start(), m.end(1)) for m in re.finditer(f"(?=({V.CLIENT_SECTION}))", text, re.I))


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return ""


def links(page: Page, url: str, *, same_host: bool = False) -> tuple[list[str], list[str]]:
    """Different links to vacancies, and to technical and commercial pages."""
    speaks = Within(page, [p.casefold() for p in page.pieces], _places_of(V.CAREER_HINTS))
    careers, signals = {}, {}
    own = _host(url)
    for i, tag in enumerate(page.tags):
        if tag != "a" or "href" not in page.attrs[i]:
            continue
        href = page.attrs[i]["href"].strip()
        if not href or href.startswith(NO_PAGE):
            continue
        link = _joined(url, href)
        low = link.casefold()
        if any(hint in low for hint in V.CAREER_HINTS) or speaks(i):
            careers.setdefault(link.rstrip("/"), link)
        try:
            parts = urlsplit(low)
        except ValueError:
            continue
        host = parts.netloc.removeprefix("www.")
        if parts.scheme in ("http", "https") and (not same_host or host == own) and (any(hint in parts.path for hint in V.SIGNAL_PATHS) or host.startswith("blog.")):
            signals.setdefault(link.rstrip("/"), link)
    return list(careers.values()), list(signals.values())


def _host(url: str) -> str:
    try:
        return urlsplit(url).netloc.casefold().removeprefix("www.")
    except ValueError:
        return ""


def job_titles(page: Page) -> list[str]:
    """Texts of headings, links, items and spans that name a technical role."""
    least, most = V.JOB_CHARS
    found: dict[str, str] = {}
    for i, tag in enumerate(page.tags):
        if tag in V.JOB_TAGS and least <= page.length(i) <= most:
            text = page.text(i)
            low = text.casefold()
            if any(word in low for word in V.ROLE_WORDS):
                found.setdefault(low, text)
    return list(found.values())


class _Rest:
    """Elements in order, each given out once: those inside a stretch that no earlier stretch had."""

    def __init__(self, numbers: list[int]):
        self.numbers, self.next = numbers, list(range(len(numbers) + 1))

    def _free(self, k: int) -> int:
        root = k
        while self.next[root] != root:
            root = self.next[root]
        while self.next[k] != root:
            self.next[k], k = root, self.next[k]
        return root

    def inside(self, begin: int, end: int) -> Iterator[int]:
        k = self._free(bisect_left(self.numbers, begin))
        while k < len(self.numbers) and self.numbers[k] < end:
            yield self.numbers[k]
            self.next[k] = k + 1
            k = self._free(k)


def client_names(page: Page) -> list[str]:
    """Names in logos, items and captions of the containers that announce clients or partners, by a heading or by class or id."""
    announces = Within(page, page.pieces, _client_places)
    near = [-2] * len(page.tags)  # the nearest container around each element; -1 for none
    containers, marked = [], []
    for i, tag in enumerate(page.tags):
        parent = page.parents[i]
        near[i] = parent if parent < 0 or page.tags[parent] in HOLDERS else near[parent]
        if tag in HEADINGS and announces(i):
            containers.append(near[i] if near[i] >= 0 else parent)
        if tag in MARKED and "class" in page.attrs[i]:
            marker = " ".join(page.attrs[i]["class"].split()) + " " + page.attrs[i].get("id", "")
            if _CLIENTS.search(marker) or "logo" in marker.casefold():
                marked.append(i)
    images = _Rest([i for i, tag in enumerate(page.tags) if tag == "img"])
    texts = _Rest([i for i, tag in enumerate(page.tags) if tag in NAMED])
    found: dict[str, str] = {}

    def add(raw: str) -> None:
        name = _JUNK.sub("", " ".join(raw.split())).strip(" -–—:|")
        if 2 <= len(name) <= 60 and not _CLIENTS.fullmatch(name):
            found.setdefault(name.casefold(), name)

    for c in [*containers, *marked]:
        begin, end = (0, len(page.tags)) if c < 0 else (c + 1, page.ends[c])
        for i in images.inside(begin, end):
            add(page.attrs[i].get("alt") or page.attrs[i].get("title") or "")
        for i in texts.inside(begin, end):
            if 0 < page.words[page.last[i]] - page.words[page.first[i]] <= 5:
                add(page.text(i))
    return list(found.values())


def extracted(html: str | None, url: str | None, *, same_host: bool = False) -> tuple[list[str], list[str], list[str], list[str]]:
    """Links to vacancies, other telling links, job titles, client names."""
    page = Page(html or "")
    careers, signals = links(page, url or "", same_host=same_host)
    return careers, signals, job_titles(page), client_names(page)
