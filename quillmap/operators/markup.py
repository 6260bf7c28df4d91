"""A tree of a document's elements that survives whatever is wrong with it.

One pass of a compiled pattern makes tokens; elements are hung on the innermost
one still open. Names of open elements are kept apart from the elements: a
closing tag that does not match is an error that takes a name away and closes
nothing.

Rules of our own where mapper documents leave it open: an end tag goes to the
next ``>``; a start tag goes to the first ``>`` outside quotes; a construct that
never ends is one error at its beginning, and nothing after it is read; ``<!``
that opens neither a comment, a character section nor a document type is skipped
to the next ``<``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from quillmap.functions.placeholders import Segment

from . import messages

# The entities that need no declaration.
ENTITIES = {b"lt": b"<", b"gt": b">", b"amp": b"&", b"apos": b"'", b"quot": b'"'}

#: A start tag: to the first ``>`` outside quotes. Nothing is tried twice.
OPEN = re.compile(rb"""<[^!?/](?:[^"'>]++|"[^"]*"|'[^']*')*+>""")
#: What text with an ``&`` in it falls into.
PIECE = re.compile(rb"(?P<ref>&[^;&]*;)|(?P<amp>&[^&]*)|(?P<text>[^&]+)")
NAME = re.compile(rb"[^ \t\n\x0c\r/>]*")
ATTRIBUTE = re.compile(rb"""[ \t\n\x0c\r]*([^= \t\n\x0c\r>/]*)[ \t\n\x0c\r]*(=[ \t\n\x0c\r]*(?:"([^"]*)"|'([^']*)')?)?""")
BRACKET = re.compile(rb"[<>]")


def note(code: str, start: int, end: int, message: str) -> dict:
    return {"code": code, "span": {"start": start, "end": end}, "message": message}


@dataclass(slots=True)
class Element:
    """``items``: segments of text and elements, in order; ``notes``: what is wrong at this level."""

    name: str
    start: int
    tag_end: int
    end: int
    items: list = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)
    empty: bool = False
    lost: dict | None = None  # set if it is still open where the document ends
    attributes: dict | None = None  # once they have been read
    repeats: list = field(default_factory=list)

    @property
    def span(self) -> dict:
        return {"start": self.start, "end": self.end}


def attributes(source: bytes, element: Element) -> dict[bytes, tuple[int, int]]:
    """Where the values of a start tag's attributes are; later ones of a name are ``repeats``."""
    if element.attributes is not None:
        return element.attributes
    last = element.tag_end
    at = NAME.match(source, element.start + 1, last).end()
    found = element.attributes = {}
    while True:
        m = ATTRIBUTE.match(source, at, last)
        name = m[1]
        if m.start(2) < 0:
            if not name:  # the tag's end
                return found
        else:
            span = m.span(3) if m.start(3) >= 0 else m.span(4)
            if span[0] < 0:
                return found
            if name in found:
                element.repeats.append((name, *m.span(1)))
            else:
                found[name] = span
        at = m.end()


def attribute(source: bytes, element: Element, name: str, notes: list[dict]) -> dict | None:
    """{value, span} of the first attribute of that name; repeats are noted."""
    wanted = name.encode()
    span = attributes(source, element).get(wanted)
    if span is None:
        return None
    for other, start, end in element.repeats:
        if other == wanted:
            notes.append(note("duplicate_attribute", start, end, messages.REPEATED.format(name)))
    return {"value": source[span[0] : span[1]].decode(), "span": {"start": span[0], "end": span[1]}}


def character(reference: bytes) -> bytes | None:
    """What ``&...;`` stands for; None if nothing."""
    name = reference[1:-1]
    if not name.startswith(b"#"):
        return ENTITIES.get(name)
    digits, base = (name[2:], 16) if name[1:2] == b"x" else (name[1:], 10)
    if not re.fullmatch(rb"[0-9A-Fa-f]+" if base == 16 else rb"[0-9]+", digits) or len(digits) > 10:
        return None
    code = int(digits, base)
    return None if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code).encode()


def doctype_end(source: bytes, at: int) -> int:
    """Behind a ``<!DOCTYPE ...>``, whose brackets may hold further tags; -1: never."""
    depth = 0
    for m in BRACKET.finditer(source, at):
        depth += 1 if m[0] == b"<" else -1
        if not depth:
            return m.end()
    return -1


#: Names of elements without their prefix, as they come up.
LOCAL: dict[bytes, str] = {}


def local(name: bytes) -> str:
    known = LOCAL.get(name)
    if known is None:
        if len(LOCAL) > 10_000:
            LOCAL.clear()
        known = LOCAL[name] = name.split(b":", 1)[-1].decode("utf-8", "replace")
    return known


#: What else begins with ``<!`` or ``<?``: (beginning, end, kind).
SECTIONS = ((b"<!--", b"-->", ""), (b"<![CDATA[", b"]]>", "chars"), (b"<?", b"?>", ""))


def tokens(source: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, detail); kinds: open, empty, close, error, text, amp, ref, chars."""
    names: list[bytes] = []
    at, size, find = 0, len(source), source.find
    while at < size:
        start = find(b"<", at)
        if start < 0:
            start = size
        if start > at:
            if find(b"&", at, start) < 0:
                yield "text", at, start, ""
            else:
                for m in PIECE.finditer(source, at, start):
                    yield m.lastgroup, m.start(), m.end(), ""
            if start == size:
                return
        second = source[start + 1 : start + 2]
        if second == b"/":
            end = find(b">", start)
            if end < 0:
                break
            at = end + 1
            name = source[start + 2 : end].rstrip(b" \t\n\x0c\r")
            opened = names.pop() if names else None
            if opened == name:
                yield "close", start, at, ""
            else:
                shown = name.decode("utf-8", "replace")
                because = f"</{shown}> closes nothing" if opened is None else f"</{shown}> where </{opened.decode('utf-8', 'replace')}> was due"
                yield "error", start, start, f"orphan or mismatched closing tag ignored: {because}"
        elif second in (b"!", b"?"):
            section = next((x for x in SECTIONS if source.startswith(x[0], start)), None)
            end = find(section[1], start + len(section[0])) if section else -1
            if end >= 0:
                at = end + len(section[1])
                if section[2]:
                    yield section[2], start, at, ""
                continue
            if second == b"?":
                break
            doctype = source[start + 2 : start + 9].upper() == b"DOCTYPE"
            at = doctype_end(source, start) if doctype else 0
            if at > 0:
                continue
            yield "error", start, start, "malformed markup skipped, resynchronizing: malformed declaration"
            at = find(b"<", start + 1) if not doctype and not section else -1
            if at < 0:
                return
        else:
            m = OPEN.match(source, start)
            if m is None:
                break
            at = m.end()
            name = NAME.match(source, start + 1)[0]
            if source[at - 2] == 47:
                yield "empty", start, at, local(name)
            else:
                names.append(name)
                yield "open", start, at, local(name)
    else:
        return
    yield "error", start, start, "malformed markup skipped, resynchronizing: markup never ends"


def reference_note(source: bytes, kind: str, start: int, end: int) -> dict | None:
    """What is wrong with a reference or a lone ``&``, if anything."""
    if kind == "amp":
        return note("invalid_entity", start, start + 1, messages.LONE_AMPERSAND)
    if kind == "ref" and character(source[start:end]) is None:
        return note("invalid_entity", start, end, f"unresolvable entity reference: {source[start:end].decode('utf-8', 'replace')}")
    return None


def segment(source: bytes, kind: str, start: int, end: int) -> Segment:
    if kind == "chars":
        return Segment(source[start + 9 : end - 3], start + 9, end - 3)
    raw = source[start:end]
    return Segment((character(raw) if kind == "ref" else None) or raw, start, end)


@dataclass
class Document:
    """The root, what lies directly in it and around it, and how it ends.

    ``before`` and ``after`` are notes outside the root; ``inside`` has the
    root's children and notes between them in order. ``ending``: what is never
    closed: "", "root" or "child".
    """

    root: Element | None = None
    before: list[dict] = field(default_factory=list)
    inside: list = field(default_factory=list)
    after: list[dict] = field(default_factory=list)
    ending: str = ""


def read(source: bytes) -> Document:
    """The tree of a document of UTF-8 bytes. Never raises."""
    doc, open_ = Document(), []
    closed = False
    for kind, start, end, detail in tokens(source):
        if closed or doc.root is None:
            if kind in ("open", "empty") and doc.root is None:
                doc.root = Element(detail, start, end, end, empty=kind == "empty")
                open_ = [] if doc.root.empty else [doc.root]
                closed = doc.root.empty
            elif kind == "error" and doc.root is None:
                doc.before.append(note("unclosed_tag", start, start, detail))
            elif problem := reference_note(source, kind, start, end):
                (doc.after if closed else doc.before).append(problem)
            continue
        top = open_[-1]
        if kind in ("open", "empty"):
            child = Element(detail, start, end, end, empty=kind == "empty")
            (doc.inside if len(open_) == 1 else top.items).append(child)
            if kind == "open":
                open_.append(child)
        elif kind == "close":
            top.end = end
            open_.pop()
            closed = not open_
        elif kind == "error":
            problem = note("unclosed_tag", start, start, detail)
            (doc.inside if len(open_) == 1 else open_[1].notes).append(problem)
        else:
            problem = reference_note(source, kind, start, end)
            if len(open_) == 1:
                if problem:
                    doc.inside.append(problem)
                continue
            if problem:
                top.notes.append(problem)
            top.items.append(segment(source, kind, start, end))
    if open_ and not closed:
        end = len(source)
        for e in open_:
            e.end = end
        doc.ending = "root" if len(open_) == 1 else "child"
        if len(open_) > 1:
            told = "statement body was never closed"
            if len(open_) > 2:  # what never closed inside a child is no part of it
                open_[1].items.remove(open_[2])
                told = f"<{open_[2].name}> was never closed"
            open_[1].lost = note("unclosed_tag", open_[min(2, len(open_) - 1)].start, end, told)
    return doc
