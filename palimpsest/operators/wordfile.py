"""The byte reader: word-processor files and print streams to a typed document, one pass, no shuffle.

Bytes become a stream of events (text, toggles, framed blocks, returns), and events become physical lines of styled
spans. Every line keeps its own bytes and its return, so a document that wasn't edited is written back byte for byte.
Lines, notes, dot commands and blocks are arrays of structs, to be exploded into tables where they are analysed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .codec import glyph

#: Fixed: style toggles, codes that mean nothing, note kinds, releases, print codes.
TOGGLES = {0x02: "b", 0x04: "b", 0x13: "u", 0x14: "sup", 0x16: "sub", 0x18: "strike", 0x19: "i"}
TOGGLE_OF = {"b": 0x02, "u": 0x13, "sup": 0x14, "sub": 0x16, "strike": 0x18, "i": 0x19}
SILENT = {0x03, 0x0B, 0x10, 0x11, 0x12, 0x15, 0x17, 0x1C}
NOTES = {3: "footnote", 4: "endnote", 5: "annotation", 6: "comment"}
RELEASES = {0x50, 0x55, 0x60, 0x70}
PRINT_CODES = {0x05: ("i", 1), 0x06: ("i", 0), 0x10: ("u", 1), 0x11: ("u", 0), 0x12: ("sup", 0), 0x13: ("i", 1), 0x15: ("i", 0), 0x18: ("sup", 1), 0x1E: ("b", 1), 0x1F: ("b", 0)}
#: Fixed: controls that newer files write with bit 7 set, outside wrapped characters.
FLAGGED = {0x82: 0x02, 0x8C: 0x0C, 0x94: 0x14}
#: Fixed: bits of a style record's attribute word.
ATTRIBUTES = {1: "strike", 2: "b", 8: "u", 16: "sub", 32: "sup", 64: "b", 128: "i"}

#: Runs of bytes that are text as they are: where bit 7 marks word ends, and where it doesn't.
_plain_flagged = re.compile(rb"[\x20-\x7e\xa0-\xfe\t\x89]+")
_plain = re.compile(rb"[\x20-\x7e\t\x80\x81\x83-\x89\x8b\x8e-\x93\x95-\x9f\xa1-\xff]+")
_without_flag = bytes(b & 0x7F for b in range(256))
_return = re.compile(rb"[\x8d\x0d][\x8a\x0a]|[\x8d\x8a\x0d\x0a]")
_dot = re.compile(r"^\.([LFEPlfep]#|[A-Za-z]{1,3})\s*(.*)$", re.S)


class ParseError(ValueError):
    """The bytes are no document; ``kind`` says why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Span:
    text: str
    styles: tuple[str, ...] = ()
    font: int | None = None
    colour: int | None = None
    ref: int | None = None  #: which note, from 0
    width: int | None = None  #: of a print control's display string, in 1800ths of an inch
    pix: int | None = None  #: which graphic, from 0


@dataclass
class Line:
    spans: list[Span] = field(default_factory=list)
    raw: bytes = b""
    brk: bytes = b""
    sep: str = ""
    tab_indent: bool = False
    page: bool = False  #: a form feed stands before it
    over: bool = False  #: the next line is printed over it
    lead: float | None = None  #: line height in force, if it isn't the document's

    @property
    def text(self) -> str:
        """What is seen, without note marks."""
        return "".join(s.text for s in self.spans if s.ref is None)

    @property
    def soft(self) -> bool:
        return self.sep in ("wrap", "blank-soft")

    @property
    def hard(self) -> bool:
        return self.brk[:1] in (b"\r", b"\n")


@dataclass
class Note:
    kind: str
    text: str = ""
    number: int | None = None
    tag: str | None = None
    line_count: int = 0
    number_format: int = 0
    convert_to: int = 0
    origin: str = "block"


@dataclass
class Document:
    variant: str
    lines: list[Line] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)
    fonts: list[dict] = field(default_factory=list)
    styles: list[dict] = field(default_factory=list)
    graphics: list[str] = field(default_factory=list)
    includes: list[str] = field(default_factory=list)
    unknown: list[tuple[int, int, bytes]] = field(default_factory=list)
    marks: list[tuple[int, str, int]] = field(default_factory=list)
    shifted: list[bytes] = field(default_factory=list)
    tally: dict[int, int] = field(default_factory=dict)
    release: str | None = None
    driver: str | None = None
    tail: bytes = b""
    margin: int = 65


def u16(b: bytes, at: int = 0) -> int:
    return int.from_bytes(b[at : at + 2], "little")


def i16(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "little", signed=True)


def framed(data: bytes, at: int) -> tuple[int, bytes, int] | None:
    """Command, content and end of the block that opens at an offset, if its frame closes and echoes its length."""
    if at + 3 > len(data):
        return None
    jump = u16(data, at + 1)
    close = at + 2 + jump
    if jump < 4 or close >= len(data) or data[close] != 0x1D or u16(data, close - 2) != jump:
        return None
    return data[at + 3], data[at + 4 : close - 2], close + 1


def classify(data: bytes) -> str:
    """The variant, by the same ladder as the column version."""
    head = framed(data, 0) if data[:1] == b"\x1d" else None
    if len(data) >= 8 and head and head[0] == 0 and 8 <= u16(data, 1) < 0x400 and data[4] in RELEASES:
        return "ws5+"
    core = data.partition(b"\x1a")[0]
    n = len(core)
    if not n:
        return "binary"
    soft, hard, blocks = core.count(b"\x8d\n"), core.count(b"\r\n"), core.count(b"\x1d")
    trips = len(re.findall(rb"(?s)\x1b.\x1c", core))
    high = len(re.findall(rb"[\x80-\xff]", core))
    share = min(100, (len(re.findall(rb"[\x20-\x7e\xa0-\xfe\r\n\t]", core)) + 2 * trips) * 100 // n)
    if share < 40:
        return "binary"
    if blocks >= 2 or trips >= 3:
        return "ws5+"
    if soft >= 3 or (high >= max(1, n // 20) and share >= 70):
        return "ws5+" if soft >= 3 and high < soft // 4 else "ws4"
    if share >= 90:
        return "printstream" if hard >= 2 else "text"
    return "binary"


class Reader:
    """Reads one document. ``flags``: whether bit 7 marks word ends; ``blocks``: whether framed blocks exist."""

    def __init__(self, data: bytes, variant: str, encoding: str = "cp437"):
        self.data, self.encoding = data, encoding
        self.flags, self.blocks = variant == "ws4", variant == "ws5+"
        self.doc = Document(variant)
        self.styles: set[str] = set()
        self.font: int | None = None
        self.colour: int | None = None
        self.line, self.held = Line(), bytearray()
        self.shift: list[bytes] = []
        self.on_block: dict[int, Callable[[bytes, int], None]] = {
            0x00: self.header, 0x01: self.coloured, 0x02: self.typeface, 0x15: self.typeface, 0x09: self.tab, 0x0B: self.page_end, 0x0D: self.numbered,
            0x0E: self.phrase, 0x0F: self.control, 0x10: self.graphic, 0x11: self.style, 0x16: self.truncated, 0x17: self.shifted,
        }
        self.on_block |= dict.fromkeys(NOTES, self.note)

    def flush(self) -> None:
        if self.held:
            self.line.spans.append(Span(self.held.decode(self.encoding, "replace"), tuple(sorted(self.styles)), self.font, self.colour))
            self.held.clear()

    def show(self, text: str, width: int | None = None, pix: int | None = None) -> None:
        self.flush()
        self.line.spans.append(Span(text, tuple(sorted(self.styles)), self.font, self.colour, None, width, pix))

    def say(self, text: str) -> None:
        self.held += text.encode(self.encoding, "replace")

    def read(self) -> Document:
        data, at, start = self.data, 0, 0
        run = _plain_flagged if self.flags else _plain
        while at < len(data):
            m = run.match(data, at)
            if m:
                self.held += m[0].translate(_without_flag) if self.flags else m[0]
                at = m.end()
                continue
            b = data[at]
            if b == 0x1A:
                break
            if b == 0x1B and at + 1 < len(data):
                self.wrapped(data[at + 1])
                at += 3 if data[at + 2 : at + 3] == b"\x1c" else 2
                continue
            if b == 0x1D and self.blocks:
                found = framed(data, at)
                if found:
                    command, content, at_next = found
                    self.on_block.get(command, self.other)(content, at)
                    at = at_next
                    continue
                at += 1
                continue
            if b in (0x0D, 0x0A, 0x8D, 0x8A) and not (self.blocks and b == 0x8A and data[at - 1 : at] not in (b"\r", b"\x8d")):
                m = _return.match(data, at)
                self.close(data[start:at], m[0])
                at = start = m.end()
                continue
            if self.blocks:
                b = FLAGGED.get(b, b)
            if b == 0x0C:
                own = data[at : at + 1]  # plain or flagged
                self.close(data[start:at], own) if at > start else None
                self.line.page = True
                self.line.raw += own if at == start else b""
                at += 1
                start = at
                continue
            self.byte(b & 0x7F if self.flags else b)
            at += 1
        self.close(data[start:at], b"")
        self.doc.tail = data[at:]
        texts = [x.text for x in self.doc.lines]
        self.doc.margin = margin(self.doc.lines, texts)
        separate(self.doc.lines, texts, self.doc.margin, self.blocks)
        return self.doc

    def close(self, raw: bytes, brk: bytes) -> None:
        self.flush()
        if raw or brk or self.line.spans or self.line.raw:
            self.line.raw, self.line.brk = self.line.raw + raw, brk
            self.doc.lines.append(self.line)
        self.line = Line()

    def byte(self, b: int) -> None:
        if b in TOGGLES:
            self.flush()
            self.styles ^= {TOGGLES[b]}
        elif b in (0x01, 0x0E):
            self.flush()
            self.styles = self.styles | {"altfont"} if b == 0x01 else self.styles - {"altfont"}
        elif b == 0x0F or (b == 0xA0 and not self.flags):
            self.held.append(0x20)
        elif b == 0x1F:
            self.held.append(0x2D)
        elif b >= 0x20 and b != 0x7F or b == 0x09:
            self.held.append(b)
        elif b != 0x1E and b not in SILENT:
            self.doc.tally[b] = self.doc.tally.get(b, 0) + 1

    def wrapped(self, b: int) -> None:
        if 0x20 <= b != 0x7F:
            self.held.append(b)
        else:
            self.flush()
            self.line.spans.append(Span(glyph(b) if b else " ", tuple(sorted(self.styles)), self.font, self.colour))

    # framed blocks

    def other(self, content: bytes, at: int) -> None:
        self.doc.unknown.append((self.data[at + 3], at, content))

    def header(self, content: bytes, at: int) -> None:
        if content[:1] and content[0] in RELEASES:
            self.doc.release = f"{content[0] >> 4}.{content[0] & 15}"
        name = re.search(rb"[A-Z0-9]+", bytes(c & 0x7F for c in content))
        if name is None:
            self.other(content, at)
        elif self.doc.driver is None:
            self.doc.driver = name[0].decode()
        if len(content) >= 14:
            self.doc.styles = self.doc.styles or style_library(self.data, int.from_bytes(content[12:16], "little"), self.encoding)

    def coloured(self, content: bytes, at: int) -> None:
        if len(content) >= 2:
            self.flush()
            self.colour = content[0] or None

    def typeface(self, content: bytes, at: int) -> None:
        if len(content) >= 6:
            self.flush()
            self.doc.fonts.append({"width_hmi": u16(content), "height_vmi": u16(content, 2), "typestyle": u16(content, 4)})
            self.font = len(self.doc.fonts) - 1

    def tab(self, content: bytes, at: int) -> None:
        self.line.tab_indent |= not self.held and not self.line.spans
        if len(content) < 5:
            self.say("    ")
            return
        plain = content[4] in b"\x20\xa0#![]"
        self.held += (b" " if plain else bytes([content[4]])) * max(1, round(u16(content) / 180))

    def page_end(self, content: bytes, at: int) -> None:
        self.doc.marks.append((len(self.doc.lines), "softpage", 0))

    def numbered(self, content: bytes, at: int) -> None:
        if len(content) >= 5:
            level = min(content[2], 8, (len(content) - 3) // 2)
            self.say(".".join(str(u16(content, 3 + 2 * k) + 1) for k in range(level)))

    def phrase(self, content: bytes, at: int) -> None:
        self.say(visible(content))

    def control(self, content: bytes, at: int) -> None:
        if len(content) < 3:
            return self.other(content, at)
        shown = "".join(chr(c) for c in content[3 : 3 + content[2]] if 0x20 <= c < 0x7F)
        _, mark, name = visible(content[3 + content[2] :]).partition("%F")
        name = name.strip().strip('"')
        if mark and name:
            self.doc.includes.append(name)
            self.say(f"[include: {name}]")
        elif shown.strip():
            self.doc.marks.append((len(self.doc.lines), "pctl", u16(content)))
            self.show(shown, width=u16(content))
        else:
            self.other(content, at)

    def graphic(self, content: bytes, at: int) -> None:
        path = visible(content)
        self.doc.marks.append((len(self.doc.lines), "pix", len(self.doc.graphics)))
        self.doc.graphics.append(path)
        self.show(f"[image: {re.split(r'[/\\]', path)[-1] or path}]", pix=len(self.doc.graphics) - 1)

    def style(self, content: bytes, at: int) -> None:
        if len(content) == 8:
            self.doc.marks.append((len(self.doc.lines), "style", u16(content)))
        else:
            self.other(content, at)

    def truncated(self, content: bytes, at: int) -> None:
        self.say("<TRUNCATED>")

    def shifted(self, content: bytes, at: int) -> None:
        if content[:1] and content[0]:
            self.flush()
            self.shift.append(b"")
        elif self.shift:
            self.shift.pop()
            run = bytes(self.held)
            self.held.clear()
            self.doc.shifted.append(run)
            self.say(f"[shift-jis: {len(run)} bytes]")

    def note(self, content: bytes, at: int) -> None:
        kind = NOTES[self.data[at + 3]]
        self.flush()
        self.line.spans.append(Span(str(len(self.doc.notes) + 1), tuple(sorted(self.styles | {"sup"})), self.font, self.colour, len(self.doc.notes)))
        note = Note(kind)
        self.doc.notes.append(note)
        if len(content) < 5:
            return
        counted = kind in ("footnote", "endnote")
        flag, body, rest = content[4], bytearray(), content[5:]
        note.line_count = u16(content)
        note.number = u16(content, 2) if counted and not u16(content, 2) & 0x8000 else None
        k = 0
        while k < len(rest):
            inner = framed(rest, k) if rest[k] == 0x1D else None
            if inner is None:
                body.append(rest[k])
                k += 1
                continue
            command, tag, k = inner
            if command == self.data[at + 3] and counted and len(tag) >= 5:
                note.number, flag = u16(tag, 2), tag[4]
            elif command == self.data[at + 3] and kind == "annotation":
                note.tag = "".join(c for c in tag[5:].decode(self.encoding) if c >= " ").strip() or None
        if kind != "annotation":
            note.number_format, note.convert_to = flag >> 4, flag & 15
        kept = (x for x in _return.split(bytes(body)) if x[:1] not in (b".", b"\xae"))
        said = (bytes(c for c in x if 0x20 <= c != 0x7F or c == 9).decode(self.encoding).strip() for x in kept)
        note.text = " ".join(x for x in said if x)


def visible(b: bytes) -> str:
    return "".join(chr(c & 0x7F) for c in b if 0x20 <= c & 0x7F < 0x7F)


def style_library(data: bytes, base: int, encoding: str) -> list[dict]:
    """Records of the style library at an offset: a chain of index blocks, each with entries of 33 bytes."""
    out: list[dict] = []
    if not 0 < base <= len(data) - 13 or data[base : base + 2] != b"\x1aU":
        return out
    allowed, width = u16(data, base + 5), u16(data, base + 7)
    link, seen, slot = int.from_bytes(data[base + 9 : base + 13], "little"), set(), 0
    while link and link not in seen and base + link <= len(data) - 5:
        seen.add(link)
        at = base + link
        count, link = data[at], int.from_bytes(data[at + 1 : at + 5], "little")
        for k in range(count):
            entry = data[at + 5 + 33 * k : at + 38 + 33 * k]
            if slot >= allowed or len(entry) < 33:
                break
            slot += 1
            if entry[:24] == b"?" * 24:
                continue
            record = base + int.from_bytes(entry[29:33], "little")
            style = {"slot": slot - 1, "name": entry[:24].decode(encoding).rstrip()}
            if entry[24] == 2 and record > base and record + width <= len(data):
                said = lambda o, none: None if i16(data, record + o) == none else i16(data, record + o)  # noqa: E731, B023
                style |= {"left": said(10, -2), "right": said(12, -2), "para": said(14, -2), "line_height_vmi": said(88, -1)}
                style["font"] = None if i16(data, record) == -1 else tuple(u16(data, record + 2 * k) for k in range(3))
                style["wrap"] = {0: False, 255: None}.get(data[record + 87], True)
                style["colour"] = None if data[record + 95] == 255 else data[record + 95]
                bits = u16(data, record + 91)
                style["align"] = JUSTIFIED.get(int.from_bytes(data[record + 86 : record + 87], "little", signed=True))
                style["attrs"] = sorted({tag for bit, tag in ATTRIBUTES.items() if bits & bit})
            out.append(style)
    return out


def heading_level(name: str) -> int | None:
    """Level of a heading from its style's name."""
    n = name.lower()
    m = re.match(r"^h([1-3])\b", n)
    if m:
        return int(m[1])
    if "subhead" in n or "section heading" in n:
        return 2
    return 1 if "title" in n else None


JUSTIFIED = {0: "left", 1: "justify", -2: "center", -3: "right"}


def margin(lines: list[Line], texts: list[str]) -> int:
    """The length at nine tenths of the soft-returned lines' lengths, at least 65."""
    n = sorted(len(t.rstrip()) for x, t in zip(lines, texts, strict=True) if x.brk[:1] in (b"\x8d", b"\x8a") and t.strip())
    return max(65, n[int(0.9 * len(n))] if n else 0)


def separate(lines: list[Line], texts: list[str], width: int, soft_is_wrap: bool) -> None:
    """Break kinds, from the last line back: what follows a line is known when it is reached."""
    ahead = None  # the text of the next line that isn't blank, without an indent that a tab made
    hard = total = 0
    for line, own in zip(reversed(lines), reversed(texts), strict=True):
        own_hard = line.hard or line.brk in (b"\x0c", b"\x8c")
        if not own.strip():
            line.sep = "blank-hard" if own_hard else "blank-soft"
            hard += own_hard
            total += bool(line.brk)
            continue
        hard, total = hard + own_hard, total + bool(line.brk)
        if ahead is None:
            line.sep = "eof"
        elif hard and total >= 2:
            line.sep = "para"
        elif hard:
            line.sep = "line"
        else:
            fits = not soft_is_wrap and len(own.rstrip()) + 1 + len(ahead.split(" ", 1)[0]) < width
            line.sep = "line" if ahead.startswith(" ") or fits else "wrap"
        ahead, hard, total = own.lstrip(" ") if line.tab_indent else own, 0, 0


def read_print(data: bytes, encoding: str = "cp437", codes: dict[int, tuple[str, int]] | None = None) -> Document:
    """A print stream: lines verbatim, style codes decoded, form feeds as page breaks, other controls dropped."""
    doc, line, held, styles = Document("printstream"), Line(), bytearray(), set()
    codes = PRINT_CODES if codes is None else codes

    def flush() -> None:
        if held:
            line.spans.append(Span(held.decode(encoding), tuple(sorted(styles))))
            held.clear()

    body, mark, rest = data.partition(b"\x1a")
    start = 0
    for at, b in enumerate(body):
        b &= 0x7F
        if b in codes:
            flush()
            tag, on = codes[b]
            styles = styles | {tag} if on else styles - {tag}
        elif b in (0x0A, 0x0C):
            flush()
            whole = body[start : at + 1]
            cut = 2 if whole.endswith(b"\r\n") else 1
            line.raw, line.brk, line.sep = whole[:-cut], whole[-cut:], "line"
            doc.lines.append(line)
            line, start = Line(page=b == 0x0C), at + 1
        elif b >= 0x20 and b != 0x7F or b == 0x09:
            held.append(b)
    flush()
    line.raw, line.sep = body[start:], "eof"
    if line.raw or line.page:
        doc.lines.append(line)
    doc.tail = mark + rest
    return doc


def parse(data: bytes, variant: str | None = None, encoding: str = "cp437") -> Document:
    """Reads a document of the variant it is, or of the one that is named."""
    if not data:
        raise ParseError("empty", "no bytes")
    kind = variant or classify(data)
    if kind == "binary":
        raise ParseError("binary", "not a document")
    return Reader(data, kind, encoding).read() if kind in ("ws3", "ws4", "ws5+") else read_print(data, encoding)


SPAN = "struct<text:string,styles:array<string>,font:int,colour:int,ref:int>"
SCHEMA = f"""doc_id long, variant string, release string, driver string, margin int,
 lines array<struct<pos:int,sep:string,hard:boolean,page:boolean,text:string,spans:array<{SPAN}>>>,
 notes array<struct<note_ix:int,kind:string,text:string,number:int,tag:string>>,
 dots array<struct<pos:int,cmd:string,arg:string>>, fonts array<struct<width_hmi:int,height_vmi:int,typestyle:int>>,
 graphics array<string>, includes array<string>, n_unknown int, error struct<kind:string,message:string>"""


def dots_of(doc: Document) -> Iterator[tuple[int, str, str]]:
    for pos, line in enumerate(doc.lines):
        m = _dot.match(line.text) if doc.variant.startswith("ws") else None
        if m:
            yield pos, m[1].lower(), m[2].strip()


def listed(parts: list[list], kind: pa.DataType) -> pa.ListArray:
    """One list for each document, from lists of values of a type."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([v for x in parts for v in x], kind))


def structs(parts: list[list[tuple]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """One list of structs for each document, from lists of tuples. Columns are built whole, without dicts."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    columns = list(zip(*(v for x in parts for v in x), strict=True)) or [()] * len(fields)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, names=list(fields)))


def lines_of(docs: list[Document | None]) -> pa.ListArray:
    lines = [d.lines if d else [] for d in docs]
    flat = [x for part in lines for x in part]
    spans = [s for x in flat for s in x.spans]
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    integer = lambda values: pa.array(values, pa.int32())
    styles = listed([list(s.styles) for s in spans], pa.string())
    span = pa.StructArray.from_arrays([pa.array([s.text for s in spans], pa.string()), styles, integer([s.font for s in spans]), integer([s.colour for s in spans]), integer([s.ref for s in spans])], names=["text", "styles", "font", "colour", "ref"])
    held = pa.ListArray.from_arrays(ends([len(x.spans) for x in flat]), span)
    pos = integer([k for part in lines for k in range(len(part))])
    columns = [pos, pa.array([x.sep for x in flat], pa.string()), pa.array([x.hard for x in flat], pa.bool_()), pa.array([x.page for x in flat], pa.bool_()), pa.array([x.text for x in flat], pa.string()), held]
    return pa.ListArray.from_arrays(ends([len(x) for x in lines]), pa.StructArray.from_arrays(columns, names=["pos", "sep", "hard", "page", "text", "spans"]))


def parsed(data: bytes | None, encoding: str, variant: str | None) -> Document | ParseError:
    try:
        return parse(data or b"", variant, encoding)
    except ParseError as e:
        return e


def batch_of(ids: pa.Array, found: list[Document | ParseError]) -> pa.RecordBatch:
    docs = [d if isinstance(d, Document) else None for d in found]
    errors = [None if d else {"kind": e.kind, "message": str(e)} for d, e in zip(docs, found, strict=True)]
    one = lambda name, kind: pa.array([getattr(d, name) if d else None for d in docs], kind)
    many = lambda name: [getattr(d, name) if d else [] for d in docs]
    text, integer = pa.string(), pa.int32()
    columns = {
        "doc_id": ids,
        "variant": one("variant", text),
        "release": one("release", text),
        "driver": one("driver", text),
        "margin": one("margin", integer),
        "lines": lines_of(docs),
        "notes": structs([[(k, n.kind, n.text, n.number, n.tag) for k, n in enumerate(x)] for x in many("notes")], {"note_ix": integer, "kind": text, "text": text, "number": integer, "tag": text}),
        "dots": structs([list(dots_of(d)) if d else [] for d in docs], {"pos": integer, "cmd": text, "arg": text}),
        "fonts": structs([[tuple(f.values()) for f in x] for x in many("fonts")], dict.fromkeys(("width_hmi", "height_vmi", "typestyle"), integer)),
        "graphics": listed(many("graphics"), text),
        "includes": listed(many("includes"), text),
        "n_unknown": pa.array([len(x) for x in many("unknown")], integer),
        "error": pa.array(errors, pa.struct([("kind", text), ("message", text)])),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def portions(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of batches of ``doc_id, content`` that hold few bytes, so that a large file is worked on alone."""
    for batch in batches:
        size = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column("content")).to_pylist()])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b


def spread_files(files: DataFrame, partitions: int | None) -> DataFrame:
    """``doc_id, content``, dealt anew where a source has fewer partitions than there are cores to parse them."""
    held = files.select(files["doc_id"].cast("long").alias("doc_id"), "content")
    return held if partitions is None else held.repartition(partitions)


def read_documents(files: DataFrame, encoding: str = "cp437", variant: str | None = None, partitions: int | None = None) -> DataFrame:
    """``doc_id, content`` to one row of typed arrays each. What can't be read is a row with an error. ``variant``
    overrules what the bytes look like."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            yield batch_of(part.column("doc_id"), [parsed(b, encoding, variant) for b in part.column("content").to_pylist()])

    return spread_files(files, partitions).mapInArrow(read, SCHEMA)
