"""Elements of HTML pages by tag, class and attribute selectors.

``read`` is one vectorized function over a column of pages.  Each page is parsed once into a flat list of
elements by a stack: an end tag closes the innermost open element of its name and what is open in it,
one that closes nothing is ignored, and what is never closed lasts to the end.  A selector is a list
of alternatives by commas, each of compounds (``div.card[data-id]``; attributes also by ``=``, ``*=``, ``^=`` and ``$=``)
joined by a blank (inside), ``>`` (child) or ``+`` (next element).
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without content or end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_HIDDEN = frozenset(("script", "style", "template"))
_STEP = re.compile(r"\s*([>+]?)\s*([\w*-]*)((?:\.[\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"\.([\w-]+)|\[([\w:-]+)(?:([*^$]?)=['\"]?([^'\"\]]*)['\"]?)?\]")
#: A plain tag, a plain comment or a text: what a page mostly consists of, and what reads the same by any parser.
_TOKEN = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \n\t]+[a-zA-Z_][a-zA-Z0-9_:-]*(?:=(?:"[^"&]*"|'[^'&]*'|[^\s"'=<>`&]+))?)*)[ \n\t]*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)>|(<!--(?:[^<>-]|-(?!-))*-->)|[^<]+""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][a-zA-Z0-9_:-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`&]+)))?""")
#: Elements whose content is no markup; scripts and styles without "<" in them are plain all the same.
_RAW = frozenset("iframe math noembed noframes noscript plaintext svg textarea title xmp".split())
#: What the sign before "=" asks of an attribute's value.
_ASKS = {"": str.__eq__, "*": str.__contains__, "^": str.startswith, "$": str.endswith}


@lru_cache(maxsize=256)
def parse_selector(selector: str) -> tuple:
    """Alternatives; each a tuple of (joined by, tag, classes, attributes), outermost first."""
    out = []
    for one in selector.split(","):
        steps, at = [], 0
        one = one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if m.end() == at or not (m[2] or m[3]):
                raise ValueError(f"no selector: {selector!r}")
            parts = [p.groups() for p in _PART.finditer(m[3])]
            steps.append((m[1] or " ", m[2].lower().replace("*", ""), frozenset(c for c, *_ in parts if c), tuple((a, _ASKS[sign or ""], v) for _, a, sign, v in parts if a)))
            at = m.end()
        out.append(tuple(steps))
    return tuple(out)


@lru_cache(maxsize=4096)
def _possible(selector: str, tag: str, classes: frozenset[str]) -> tuple:
    """The alternatives whose last compound fits this tag and these classes, shortest first; a single one without
    attributes makes the others needless."""
    some = sorted((steps for steps in parse_selector(selector) if steps[-1][1] in ("", tag) and steps[-1][2] <= classes), key=len)
    sure = [steps for steps in some if len(steps) == 1 and not steps[0][3]]
    return tuple(sure[:1] or some)


@lru_cache(maxsize=4096)
def _own(text: str) -> tuple[dict[str, str], frozenset[str]]:
    """Attributes and classes of a plain tag."""
    own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}
    return own, frozenset(own.get("class", "").split())


class Page(HTMLParser):
    """The elements of one page in document order, and its texts; element i has elements ``i + 1:end[i]``
    and texts ``text_begin[i]:text_end[i]`` in it."""

    def __init__(self, html: str):
        self._begin()
        if not self._plain(html):
            super().__init__(convert_charrefs=True)
            self._begin()
            self.feed(html)
            self.close()
        while self._open:
            self._shut()

    def _begin(self) -> None:
        self.tags: list[str] = []
        self.attributes: list[dict[str, str]] = []
        self.classes: list[frozenset[str]] = []
        self.parents: list[int] = []
        self.previous: list[int] = []
        self.end: list[int] = []
        self.text_begin: list[int] = []
        self.text_end: list[int] = []
        self.texts: list[str] = []
        self._open: list[int] = []
        self._last = {-1: -1}
        self._apart = True

    def _plain(self, html: str) -> bool:
        """Read a page of plain tokens alone, several times as fast; false at the first thing that is none, which the
        parser has to read."""
        at, raw = 0, ""
        for m in _TOKEN.finditer(html):
            begin, end = m.span()
            if begin != at:
                return False
            at = end
            kind = m.lastindex
            if kind == 3:
                tag = m[1].lower()
                if raw or tag in _RAW:
                    return False
                self._start(tag, *_own(m[2]))
                if tag in ("script", "style"):
                    raw = tag
                if m[3]:
                    if raw:
                        return False
                    if tag not in _VOID:
                        self._shut()
            elif kind == 4:
                tag = m[4].lower()
                if raw and raw != tag:
                    return False
                raw = ""
                self.handle_endtag(tag)
            elif kind == 5:
                if raw:
                    return False
                self._apart = True
            elif not raw:
                data = m[0]
                self.handle_data(unescape(data) if "&" in data else data)
        return at == len(html) and not raw

    def _shut(self) -> int:
        i = self._open.pop()
        self.end[i], self.text_end[i], self._apart = len(self.tags), len(self.texts), True
        return i

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        self._start(tag, own, frozenset(own.get("class", "").split()))

    def _start(self, tag: str, own: dict[str, str], classes: frozenset[str]) -> None:
        i, parent = len(self.tags), self._open[-1] if self._open else -1
        self.tags.append(tag)
        self.attributes.append(own)
        self.classes.append(classes)
        self.parents.append(parent)
        self.previous.append(self._last.get(parent, -1))
        self._last[parent] = i
        self.end.append(i + 1)
        self.text_begin.append(len(self.texts))
        self.text_end.append(len(self.texts))
        self._open.append(i)
        self._apart = True
        if tag in _VOID:
            self._shut()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._shut()

    def handle_endtag(self, tag: str) -> None:
        opened, tags = self._open, self.tags
        if opened and tags[opened[-1]] == tag:
            self._shut()
        elif any(tags[i] == tag for i in opened):
            while tags[self._shut()] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._open and self.tags[self._open[-1]] in _HIDDEN:
            return
        if self._apart:
            self.texts.append(data)
        else:
            self.texts[-1] += data
        self._apart = False

    def handle_comment(self, data: str) -> None:
        self._apart = True

    def _fits_any(self, i: int, some: tuple) -> bool:
        for steps in some:
            if self._fits(i, steps):
                return True
        return False

    def _fits(self, i: int, steps: tuple) -> bool:
        joined, tag, classes, attributes = steps[-1]
        if (tag and tag != self.tags[i]) or not classes <= self.classes[i]:
            return False
        if attributes:
            own = self.attributes[i]
            for a, asks, v in attributes:
                if (got := own.get(a)) is None or (v is not None and not asks(got, v)):
                    return False
        if len(steps) == 1:
            return True
        rest = steps[:-1]
        if joined == "+":
            return self.previous[i] >= 0 and self._fits(self.previous[i], rest)
        up, parents = self.parents[i], self.parents
        while up >= 0:
            if self._fits(up, rest):
                return True
            if joined == ">":
                return False
            up = parents[up]
        return False

    def select(self, selector: str, within: int = -1) -> list[int]:
        """Elements that fit, in document order; ``within`` an element, whose own ancestors count for "inside"."""
        tags, classes = self.tags, self.classes
        found = range(within + 1, self.end[within] if within >= 0 else len(tags))
        return [i for i in found if (some := _possible(selector, tags[i], classes[i])) and self._fits_any(i, some)]

    def value(self, i: int, source: str) -> str | None:
        """Of an element: "text" (its stripped texts in a row), "words" (with blanks between), else the first
        attribute of those named, by ``|``, that is not empty."""
        if source in ("text", "words"):
            parts = [t for t in map(str.strip, self.texts[self.text_begin[i] : self.text_end[i]]) if t]
            return (" " if source == "words" else "").join(parts)
        got = [self.attributes[i].get(a) for a in source.split("|")]
        return next((v for v in got if v), got[-1])

    def field(self, i: int, selectors: str | tuple[str, ...], source: str) -> str | None:
        """The value of the first element inside that fits; of several selectors the first that finds one; ``""`` is
        the element itself."""
        for selector in (selectors,) if isinstance(selectors, str) else selectors:
            if not selector:
                return self.value(i, source)
            for k in range(i + 1, self.end[i]):
                if (some := _possible(selector, self.tags[k], self.classes[k])) and self._fits_any(k, some):
                    return self.value(k, source)
        return None


#: A part of a page: the selector of its elements, and for each field a selector (or several in order) and a source.
Part = tuple[str, dict[str, tuple]]


def read(html: Column, parts: dict[str, Part]) -> Column:
    """A struct with an array per part; the array has a struct of text fields for each element, in
    document order.  A null page has empty arrays."""
    kinds = ", ".join(f"{name}: array<struct<{', '.join(f'{f}: string' for f in fields)}>>" for name, (_, fields) in parts.items())
    shape = pa.struct([(name, pa.list_(pa.struct([(f, pa.string()) for f in fields]))) for name, (_, fields) in parts.items()])

    @F.arrow_udf(f"struct<{kinds}>")
    def elements(pages: pa.Array) -> pa.Array:
        rows = []
        for html in pages.to_pylist():
            page = Page(html or "")
            rows.append({name: [{f: page.field(i, *how) for f, how in fields.items()} for i in page.select(selector)] for name, (selector, fields) in parts.items()})
        return pa.array(rows, shape)

    # else filters inferred from exploded arrays would read every page a second time
    return elements.asNondeterministic()(html)
