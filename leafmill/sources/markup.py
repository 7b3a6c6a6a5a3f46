"""XHTML of one document, read in one pass into a list of elements over one string.

The visible text of the whole document is one string; an element is an interval of it (and of the bytes it was read
from). So the text of any element is a slice, and an edit is an edit of the bytes, which leaves all else as it was.
Text in ``sup`` and ``code`` (note marks, code) is not visible. Markup that is not well-formed is read by the tolerant
HTML parser of the standard library instead; the two agree on well-formed input."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.entities import name2codepoint
from html.parser import HTMLParser
from xml.parsers import expat

HIDDEN = ("sup", "code")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Fixed value: the elements whose text is translated where nothing else is asked for.
TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote")
#: Elements that never have an end tag in HTML.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
XML_NAMES = ("amp", "lt", "gt", "quot", "apos")


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parent: int
    depth: int
    start: int  # of its visible text
    end: int = -1
    last: int = -1  # index of its last descendant, or its own
    open_from: int = -1  # its start tag in the source
    open_to: int = -1
    close_from: int = -1  # its end tag
    close_to: int = -1
    hidden: bool = False

    @property
    def cls(self) -> str:
        return self.attrs.get("class", "")

    @property
    def translated(self) -> bool:
        return "zh" in self.cls.split()


@dataclass
class Document:
    source: bytes
    elements: list[Element] = field(default_factory=list)
    visible: str = ""
    well_formed: bool = True

    def text(self, k: int) -> str:
        e = self.elements[k]
        return self.visible[e.start : e.end]

    def line(self, k: int) -> str:
        return " ".join(self.text(k).split())

    def inside(self, k: int) -> range:
        return range(k + 1, self.elements[k].last + 1)


def numeric_entities(text: str) -> str:
    """Named HTML entities as numbers, which XML knows; its own five and unknown names stay."""
    return re.sub(r"&([a-zA-Z][a-zA-Z0-9]*);", lambda m: m.group(0) if m.group(1) in XML_NAMES or m.group(1) not in name2codepoint else f"&#{name2codepoint[m.group(1)]};", text)


class _Builder:
    def __init__(self, source: bytes):
        self.document = Document(source)
        self.parts: list[str] = []
        self.length = 0
        self.open: list[int] = []

    def begin(self, tag: str, attrs: dict[str, str], at: int, to: int) -> None:
        elements = self.document.elements
        parent = self.open[-1] if self.open else -1
        hidden = tag in HIDDEN or (parent >= 0 and elements[parent].hidden)
        elements.append(Element(tag, attrs, parent, len(self.open), self.length, open_from=at, open_to=to, hidden=hidden))
        self.open.append(len(elements) - 1)

    def characters(self, text: str) -> None:
        if not (self.open and self.document.elements[self.open[-1]].hidden):
            self.parts.append(text)
            self.length += len(text)

    def finish(self, at: int, to: int) -> None:
        e = self.document.elements[self.open.pop()]
        e.end, e.last, e.close_from, e.close_to = self.length, len(self.document.elements) - 1, at, to

    def done(self) -> Document:
        while self.open:
            self.finish(len(self.document.source), len(self.document.source))
        self.document.visible = "".join(self.parts)
        return self.document


def _strict(source: bytes) -> Document:
    build = _Builder(source)
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.UseForeignDTD(True)
    local = lambda name: name.rpartition(" ")[2]

    def start(name: str, attrs: dict[str, str]) -> None:
        at = parser.CurrentByteIndex
        build.begin(local(name), {local(k): v for k, v in attrs.items()}, at, _tag_end(source, at))

    def end(_: str) -> None:
        at = parser.CurrentByteIndex
        own = build.document.elements[build.open[-1]]
        if at == own.open_from:  # closed in itself
            build.finish(own.open_to, own.open_to)
        else:
            build.finish(at, _tag_end(source, at))

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, build.characters
    parser.Parse(source, True)
    return build.done()


def _tag_end(source: bytes, at: int) -> int:
    """Behind the ``>`` of the tag that begins at ``at``; one in a quoted value doesn't count."""
    quote = 0
    for k in range(at, len(source)):
        c = source[k]
        if quote:
            quote = 0 if c == quote else quote
        elif c in (0x22, 0x27):
            quote = c
        elif c == 0x3E:
            return k + 1
    return len(source)


class _Tolerant(HTMLParser):
    def __init__(self, source: bytes):
        super().__init__(convert_charrefs=True)
        self.build = _Builder(source)
        self.text = source.decode("utf-8", "replace")
        self.lines = [0]
        for m in re.finditer("\n", self.text):
            self.lines.append(m.end())
        self.feed(self.text)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return len(self.text[: self.lines[line - 1] + column].encode())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._at()
        self.build.begin(tag.rpartition(":")[2], {k: v or "" for k, v in attrs}, at, at + len(self.get_starttag_text().encode()))
        if tag in VOID:
            own = self.build.document.elements[self.build.open[-1]]
            self.build.finish(own.open_to, own.open_to)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            own = self.build.document.elements[self.build.open[-1]]
            self.build.finish(own.open_to, own.open_to)

    def handle_endtag(self, tag: str) -> None:
        name, elements = tag.rpartition(":")[2], self.build.document.elements
        if not any(elements[k].tag == name for k in self.build.open):
            return
        at = self._at()
        while elements[self.build.open[-1]].tag != name:  # left open: ends here
            self.build.finish(at, at)
        self.build.finish(at, _tag_end(self.build.document.source, at))

    def handle_data(self, data: str) -> None:
        self.build.characters(data)


def read(raw: bytes) -> Document:
    """Raises UnicodeDecodeError for bytes that are not UTF-8; anything else gives a document."""
    source = numeric_entities(raw.decode("utf-8-sig")).encode()
    try:
        return _strict(source)
    except expat.ExpatError:
        document = _Tolerant(source).build.done()
        document.well_formed = False
        return document


def translatable(document: Document, tags: tuple[str, ...] = TAGS) -> list[int]:
    """Elements among ``tags`` that hold no other of them, are no illustration or translation, and have a letter."""
    wanted = set(tags)
    at = [k for k, e in enumerate(document.elements) if e.tag in wanted]
    out = []
    for k, after in zip(at, [*at[1:], len(document.elements)]):
        e = document.elements[k]
        if after > e.last and "illus" not in e.cls and not e.translated and any(c.isalpha() for c in document.text(k)):
            out.append(k)
    return out


def body_paragraphs(document: Document) -> list[int]:
    """The ``p`` elements in document order that are no illustration or translation and have a letter."""
    return [k for k, e in enumerate(document.elements) if e.tag == "p" and "illus" not in e.cls and not e.translated and any(map(str.isalpha, document.text(k)))]
