"""Blocks of a document, in one fold over its lines: what commands set, collect and break.

A block is a run of lines with one value of every block property (alignment, wrap, margins, columns, tab stops, style).
Commands set state from their place on; a change of a block property closes the block that is open. Page breaks and
conditional ones are blocks of their own. Commands that collect (contents, index, running heads) refer to the block that
follows them; comment lines become notes whose mark stands on the next text line.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from . import dots, wordfile
from .wordfile import Document, Line, Note, Span, heading_level

_number = re.compile(dots.NUMBER)
#: Fixed: names of commands that end with a number sign, and those of up to three letters.
_command = re.compile(r"^\.([LFEPlfep]#|[A-Za-z]{1,3})\s*(.*)$", re.S)
_head = re.compile(r"^\.(h[e1-5]|f[o1-5])\s?(.*)$", re.I | re.S)
_contents = re.compile(r"^\.tc([1-9]?)\s?(.*)$", re.I | re.S)
#: Fixed: inches of the units that an argument may name.
INCHES = {'"': 1.0, "I": 1.0, "IN": 1.0, "C": 1 / 2.54, "CM": 1 / 2.54, "P": 1 / 72, "PM": 1 / 72, "PT": 1 / 72}
#: Fixed: the spaces that begin a paragraph, how much shorter a line of verse is than the margin, blocks of a scene.
OPENING, SLACK, SCENE = " " * 5, 10, 40
#: Fixed: quotation marks; a scene's heading line.
OPENS, CLOSES = "\"'‘“", "\"'’”"
SLUGLINE = re.compile(r"^[ \t]*\d{0,4}[ \t]*(?:&[^&\r\n]{1,24}&[ \t]*)?(?:INT\.|EXT\.|INT\.?/EXT\.|I/E\.)[ \t]")


def is_command(line: Line) -> bool:
    """A line whose first character is a full stop, unless a print control's display string begins it."""
    return line.text[:1] == "." and not (line.spans and line.spans[0].width is not None)


def command(text: str) -> tuple[str, str] | None:
    """Lower-case name and argument; null for a full stop that no name follows."""
    m = _command.match(text)
    return (m[1].lower(), m[2].strip()) if m else None


def measure(arg: str, per_inch: float) -> tuple[float, bool] | None:
    """A number in units of which an inch holds ``per_inch``, and whether it named a unit."""
    m = _number.match(arg)
    if m is None:
        return None
    inches = INCHES.get((m[2] or "").upper())
    return (float(m[1]) * inches * per_inch, True) if inches else (float(m[1]), False)


def page_value(name: str, arg: str) -> float | None:
    """The argument of a page command in its own unit, as ``dots.resolved`` has it for columns."""
    found = measure(arg, dots.PER_INCH.get(name, 6.0))
    if found is None:
        return None
    value, _ = found
    if name == "ls":
        return value if not _number.match(arg)[2] and 1 <= value <= 9 else None
    return value if value > 0 or name not in ("lh", "cw") else None


def switched(arg: str) -> bool | None:
    word = arg.strip().upper()
    return True if word.startswith("ON") else False if word.startswith("OFF") else None


def roll(arg: str) -> float | None:
    """The sub- and superscript roll in 48ths of an inch."""
    m = re.match(r"\s*([0-9.]+)\s*/\s*([0-9.]+)", arg)
    if m:
        try:
            return float(m[1]) / float(m[2]) * 48
        except (ValueError, ZeroDivisionError):
            return None
    found = measure(arg, 48.0)
    return found and found[0]


@dataclass(frozen=True)
class Look:
    """The properties of which a block has one value each. Margins and tab stops are columns, null where unsaid."""

    align: str = "left"
    wrap: bool = True
    left: float | None = None
    right: float | None = None
    para: float | None = None
    columns: int | None = None
    gutter: float | None = None
    tabs: tuple[float, ...] = ()


@dataclass
class Block:
    kind: str = "para"  #: or ``pagebreak``, ``condpage``
    look: Look = field(default_factory=Look)
    lines: list[Line] = field(default_factory=list)
    style: dict | None = None
    need: int = 0  #: lines that a conditional break asks for
    origin: str = ""

    @property
    def name(self) -> str | None:
        return self.style["name"] if self.style else None

    @property
    def heading(self) -> int | None:
        return heading_level(self.name) if self.name else None

    @property
    def quote(self) -> bool:
        return "quote" in (self.name or "").lower()

    @property
    def attrs(self) -> tuple[str, ...]:
        return tuple(self.style.get("attrs", ())) if self.style else ()

    def styles(self, span: Span, heading_bold: bool = False) -> tuple[str, ...]:
        """A span's styles with those of the block's style."""
        return tuple(sorted({*span.styles, *self.attrs, *(["b"] if heading_bold and self.heading else [])}))


@dataclass
class Body:
    blocks: list[Block] = field(default_factory=list)
    notes: list[Note] = field(default_factory=list)
    page: dict[str, float] = field(default_factory=dict)
    toc: list[tuple[int, str, int]] = field(default_factory=list)
    index: list[tuple[str, int]] = field(default_factory=list)
    heads: list[tuple[str, int, str, int]] = field(default_factory=list)  #: head or foot, line, text, block
    includes: list[str] = field(default_factory=list)
    commands: list[tuple[int, int, str]] = field(default_factory=list)  #: block, line, text
    settings: dict = field(default_factory=dict)
    machine: dict[str, float] = field(default_factory=dict)  #: page values of the machine that printed it

    def value(self, name: str) -> float:
        """The document's word, then the machine's, then the default."""
        return self.page.get(name, self.machine.get(name, dots.DEFAULTS[name]))

    def source(self, name: str) -> str:
        return "file" if name in self.page else "machine-default" if name in self.machine else "default"

    @property
    def convention(self) -> int:
        """The commonest indent of the blocks' first lines; of equally common ones the first seen."""
        n: Counter[int] = Counter()
        for b in self.blocks:
            if b.kind == "para" and not b.heading:
                first = next(iter(logical(b)), None)
                if first is not None:
                    n[indent(first)] += 1
        return n.most_common(1)[0][0] if n else 0

    def front_matter(self, convention: int) -> list[bool]:
        """Whether each block stands before the first ordinary paragraph of the document, or of what a heading or page
        break begins."""
        out, front = [], True
        for b in self.blocks:
            out.append(front and b.kind == "para" and not b.heading)
            if b.kind == "pagebreak" or b.heading:
                front = True
            elif b.kind == "para" and front and b.lines:
                first = next(iter(logical(b)), None)
                front = first is None or indent(first) != convention
        return out

    @property
    def scenes(self) -> set[int]:
        """Blocks of screenplay scenes: from a block with a slugline on, up to the next one, a heading or a break."""
        paras = [b.kind == "para" for b in self.blocks]
        opens = [p and any(SLUGLINE.match("".join(s.text for s in x.spans)) for x in b.lines) for p, b in zip(paras, self.blocks, strict=True)]
        found: set[int] = set()
        left = 0
        for k, b in enumerate(self.blocks):
            if opens[k]:
                left = SCENE + 1
            elif not paras[k] or b.heading:
                left = 0
            if left > 0:
                found.add(k)
                left -= 1
        return found


class Fold:
    """The state of commands while lines go by."""

    def __init__(self, doc: Document):
        self.doc, self.body = doc, Body(includes=list(doc.includes))
        self.commands = doc.variant.startswith("ws")
        self.on: dict[str, bool] = {}
        self.justify = "left"
        self.margins: dict[str, float] = {}
        self.columns: int | None = None
        self.gutter: float | None = None
        self.tabs: tuple[float, ...] = ()
        self.lead: float = dots.DEFAULTS["lh"]
        slots = {s["slot"]: s for s in doc.styles}
        self.chosen = {at: slots.get(handle & 0xFF) if handle >> 8 == 2 else False for at, kind, handle in doc.marks if kind == "style"}
        self.style: dict | None = None
        self.waiting: list[Span] = []
        self.comments = self.refs = 0
        self.body.notes = list(doc.notes)
        self.open = Block(look=self.look())

    def look(self) -> Look:
        own = Look("center" if self.on.get("oc") else self.justify, self.on.get("aw", True), self.margins.get("lm"), self.margins.get("rm"), self.margins.get("pm"), self.columns, self.gutter, self.tabs)
        style = self.style or {}
        said = {"align": style.get("align"), "wrap": style.get("wrap"), **{k: None if style.get(k) is None else round(style[k] / 180) for k in ("left", "right", "para")}}
        return replace(own, **{k: v for k, v in said.items() if v is not None})

    def close(self) -> None:
        if self.open.lines:
            self.body.blocks.append(self.open)
        self.open = Block(look=self.look(), style=self.style)

    @property
    def ahead(self) -> int:
        """The block that what comes next will be in."""
        return len(self.body.blocks) + bool(self.open.lines)

    def take(self, pos: int, line: Line) -> None:
        if line.page:
            self.close()
            self.body.blocks.append(Block("pagebreak", origin="ff"))
        if pos in self.chosen:
            self.style = self.style if self.chosen[pos] is False else self.chosen[pos]
            self.close()
        if self.commands and is_command(line):
            self.obey(line.text.rstrip(), toggled(line.spans).rstrip())
            return
        if line.spans:
            shift = self.comments
            self.refs += sum(s.ref is not None for s in line.spans)
            if shift or self.waiting:
                line = replace(line, spans=[*self.waiting, *(s if s.ref is None else replace(s, ref=s.ref + shift) for s in line.spans)])
                self.waiting = []
        line.lead = self.lead
        if line.sep.startswith("blank"):
            last = self.body.blocks[-1] if self.body.blocks else None
            (last if not self.open.lines and last and last.kind == "para" else self.open).lines.append(line)
            return
        self.open.lines.append(line)
        if line.sep in ("para", "eof"):
            self.close()

    def obey(self, text: str, styled: str) -> None:
        self.body.commands.append((len(self.body.blocks), len(self.open.lines), text))
        found = command(text)
        if text[:2] == ".." or (found and found[0] == "ig"):
            self.comment(text[2:] if text[:2] == ".." else text[3:], ".." if text[:2] == ".." else ".ig")
            return
        head, entry = _head.match(styled), _contents.match(text)
        if head:
            place, n = head[1].lower()
            self.body.heads.append(("head" if place == "h" else "foot", 1 if n in "eo" else int(n), head[2].rstrip(), self.ahead))
        elif entry:
            self.body.toc.append((int(entry[1] or 1), entry[2].rstrip(), self.ahead))
        elif found:
            before = self.look()
            self.set(*found)
            if self.look() != before:
                self.close()

    def comment(self, text: str, origin: str) -> None:
        at = self.refs + self.comments
        self.body.notes.insert(at, Note("comment", text.strip(), origin=origin))
        self.comments += 1
        self.waiting.append(Span(str(at + 1), ("sup",), ref=at))

    def set(self, name: str, arg: str) -> None:
        said = self.body.settings
        if name in dots.DEFAULTS and name not in self.body.page:
            value = page_value(name, arg)
            if value is not None:
                self.body.page[name] = value
        match name:
            case "oc" | "aw" | "ul" | "sb" | "ps" | "kr":
                on = switched(arg)
                self.on[name] = self.on.get(name, name in ("aw", "ul")) if on is None else on
                said |= {k: v for k, v in self.on.items() if k in ("ul", "sb", "ps", "kr")}
            case "oj":
                on, first = switched(arg), arg[:1].upper()
                self.justify = "justify" if on else "left" if on is False else {"C": "center", "R": "right"}.get(first, self.justify)
            case "lh":
                self.lead = page_value("lh", arg) or self.lead
            case "lm" | "rm" | "pm":
                found = measure(arg, 10.0)
                if found:
                    self.margins[name] = found[0] if found[1] or name == "rm" else max(0.0, found[0] - 1)
            case "co":
                m = _number.match(arg)
                if m:
                    self.columns = max(1, int(float(m[1])))
                    gutter = measure(arg[m.end() :].lstrip(" \t,"), 10.0)
                    self.gutter = gutter[0] if gutter else self.gutter
            case "tb":
                found = [measure(x.lstrip("#"), 10.0) for x in arg.replace(",", " ").split()]
                self.tabs = tuple(x[0] for x in found if x) or self.tabs
            case "pr":
                said |= {"orientation": {"l": "landscape", "p": "portrait"}[arg[3:4].lower()]} if re.match(r"or=[lp]", arg, re.I) else {}
            case "op" | "pg":
                said["auto_numbers"] = name == "pg"
            case "pe":
                said["endnotes_here"] = True
            case "p#":
                said["paragraph_numbers"] = arg
            case "cc" | "cv":
                said.setdefault({"cc": "conditional_columns", "cv": "converted_notes"}[name], []).append(arg)
            case "sr":
                value = roll(arg)
                said |= {} if value is None else {"roll": value}
            case "l#":
                found = measure(arg, 1.0)
                said |= {"line_numbers": int(found[0]) or None} if found else {}
            case "f#" | "e#":
                kind, found = {"f": "footnote", "e": "endnote"}[name[0]], measure(arg, 1.0)
                if found:
                    said.setdefault(f"{kind}_start", int(found[0]))
                mode = "page" if arg.lower().startswith("page") else "continuous" if arg.lower().startswith(("cont", "consec")) else None
                said |= {f"{kind}_mode": mode} if mode else {}
            case "pt" | "psa" | "psb":
                said["foreign"] = True
            case "ix":
                self.body.index.append((arg.rstrip(), self.ahead))
            case "fi":
                if arg:
                    self.body.includes.append(arg.split()[0])
                    self.close()
                    self.body.blocks.append(Block(lines=[Line([Span(f"[insert: {arg.split()[0]}]")], sep="para")], origin="fi"))
            case "pa":
                self.close()
                self.body.blocks.append(Block("pagebreak", origin="pa"))
            case "cp":
                self.close()
                found = measure(arg, 1.0)
                self.body.blocks.append(Block("condpage", need=max(1, int(found[0])) if found else 1))

    def done(self) -> Body:
        self.close()
        default = self.body.value("lh")
        for b in self.body.blocks:
            for line in b.lines:
                line.lead = None if line.lead == default else line.lead
        self.body.settings.setdefault("orientation", "portrait")
        return self.body


def body_of(doc: Document, machine: dict[str, float] | None = None) -> Body:
    fold = Fold(doc)
    fold.body.machine = machine or {}
    for pos, line in enumerate(doc.lines):
        fold.take(pos, line)
    return fold.done()


# lines of spans


def toggled(spans: list[Span]) -> str:
    """Text with the toggle of each style before and behind the spans that have it, as running heads keep it."""
    codes = [("".join(chr(wordfile.TOGGLE_OF[t]) for t in s.styles if t in wordfile.TOGGLE_OF), s.text) for s in spans if s.ref is None]
    return "".join(c + text + c[::-1] for c, text in codes)


def seen(spans: list[Span]) -> str:
    return "".join(s.text for s in spans if s.ref is None)


def indent(spans: list[Span]) -> int:
    text = seen(spans)
    return len(text) - len(text.lstrip(" "))


def coalesced(spans: list[Span]) -> list[Span]:
    """Neighbours of equal look as one; note marks, print controls and pictures stay apart."""
    look = lambda s: None if s.ref is not None or s.width is not None or s.pix is not None else (s.styles, s.font, s.colour)
    out: list[Span] = []
    for s in spans:
        if s.text and out and look(s) is not None and look(out[-1]) == look(s):
            out[-1] = replace(out[-1], text=out[-1].text + s.text)
        elif s.text:
            out.append(s)
    return out


def without_indent(spans: list[Span]) -> list[Span]:
    """Without the spaces before the first visible character, whatever styles they have; note marks stay."""
    out, at = [], 0
    for at, s in enumerate(spans):
        text = s.text if s.ref is not None else s.text.lstrip(" ")
        if text:
            out.append(s if text == s.text else replace(s, text=text))
        if text and s.ref is None:
            break
    return out + spans[at + 1 :]


def trimmed(spans: list[Span]) -> list[Span]:
    """Without the spaces that typed alignment put at both ends."""
    back = without_indent(spans)[::-1]
    out: list[Span] = []
    for at, s in enumerate(back):
        text = s.text.rstrip(" ")
        if text:
            out = [s if text == s.text else replace(s, text=text), *back[at + 1 :]]
            break
    return out[::-1]


def logical(block: Block) -> list[list[Span]]:
    """The block's logical lines. A soft return joins by a space, unless a space or hyphen is there; what follows it
    loses its white space. Blank lines with hard returns stay between lines of text, others go."""
    out: list[list[Span]] = []
    held: list[Span] | None = None
    blanks = 0
    for line in block.lines:
        if not line.spans:
            if not line.soft:
                if held is not None:
                    out.append(coalesced(held))
                held, blanks = None, blanks + 1
            continue
        if blanks:
            out += [[] for _ in range(blanks)]
            blanks = 0
        if held is None:
            held = list(line.spans)
        else:
            rest = list(line.spans)
            while rest and not rest[0].text.strip():
                rest.pop(0)
            held += [replace(rest[0], text=rest[0].text.lstrip()), *rest[1:]] if rest else []
        if not line.soft:
            out.append(coalesced(held))
            held = None
        elif held and held[-1].text and not held[-1].text.endswith((" ", "-")):
            held.append(Span(" ", held[-1].styles))
    if held is not None:
        out.append(coalesced(held))
    return out


def trailing_blanks(block: Block) -> int:
    """Hard blank lines at the block's end."""
    n = 0
    for line in reversed(block.lines):
        if line.spans:
            break
        n += not line.soft
    return n


def ends_sentence(text: str) -> bool:
    return text.rstrip().rstrip(CLOSES).endswith((".", "!", "?"))


def quotes_itself(text: str) -> bool:
    """Opens a quotation and closes one, on one line."""
    t = text.lstrip()
    return t[:1] in tuple(OPENS) and any(c in CLOSES for c in t[1:])


def own_look(spans: list[Span]) -> tuple:
    """Look of the first visible text."""
    first = next((s for s in spans if s.ref is None and s.text.strip()), None)
    return (first.styles, first.font, first.colour) if first else ()


PLAIN: tuple = ((), None, None)


def ordinary_look(lines: list[list[Span]]) -> tuple:
    """The commonest look of a block's lines; of equally common ones the first seen."""
    n = Counter(map(own_look, lines))
    return n.most_common(1)[0][0] if n else ()


def sentence_share(lines: list[list[Span]]) -> float:
    """Share of the lines with letters that end as sentences; 1 where no line has letters."""
    scored = [t for t in map(seen, lines) if any(map(str.isalpha, t))]
    return sum(map(ends_sentence, scored)) / len(scored) if scored else 1.0


def is_verse(lines: list[list[Span]], ordinary: tuple = ()) -> bool:
    """Whether short lines are a stanza or a drawing, to be kept as they are. Ties are prose."""
    held = [x for x in lines if seen(x).strip()]
    texts = [seen(x) for x in held]
    drawn = sum(not any(map(str.isalpha, t)) and any("─" <= c <= "▟" for c in t) for t in texts)
    if len(texts) >= 2 and 2 * drawn >= len(texts):
        return True
    scored = [t for t in texts if any(map(str.isalpha, t))]
    if len(scored) < 2 or 3 * sum(map(quotes_itself, scored)) >= len(scored):
        return False
    ended = sentence_share(held)
    if ended >= 0.9:
        return False
    shifted = sum(own_look(x) not in ((), PLAIN) and own_look(x) != ordinary for x in held)
    return 2 * shifted > len(held) or ended < 0.8


@dataclass
class Unit:
    """A paragraph: logical lines, and whether they are kept apart."""

    lines: list[list[Span]]
    kept: bool = False


def paragraphs(lines: list[list[Span]], wrap: bool, margin: int, front: bool, convention: int | None, scene: bool = False) -> Iterator[Unit]:
    """Paragraphs of a block's logical lines.

    Lines that aren't to be wrapped stay as they are. So does a block that opens unlike others and reads as verse: in
    front matter by the verdict, elsewhere only if no line of it ends a sentence. Otherwise an indented line begins a
    paragraph and a flush one goes on with it; then runs of short paragraphs of one line are stanzas if the verdict says
    so, where a longer line between two short ones belongs to the run."""
    if not lines:
        return
    ordinary = ordinary_look(lines)
    unit = lambda held: Unit(held, len(held) > 1 and (not wrap or scene or is_verse(held, ordinary)))
    if not wrap:
        yield unit(lines)
        return
    if convention is not None and indent(lines[0]) != convention:
        text = [x for x in lines if seen(x).strip()]
        if len(text) >= 2 and is_verse(text, ordinary) and (front or sentence_share(text) == 0):
            yield unit(lines)
            return
    held: list[list[list[Span]]] = []
    for line in lines:
        if held and not seen(line).startswith(OPENING):
            held[-1].append(line)
        else:
            held.append([line])
    size = [len(seen(u[0]).rstrip()) if len(u) == 1 else 0 for u in held]
    short = [0 < n < max(1, margin - SLACK) for n in size]
    beside = lambda k: 0 < k < len(held) - 1 and short[k - 1] and short[k + 1]
    runs = [s or (0 < n < margin and beside(k)) for k, (s, n) in enumerate(zip(short, size, strict=True))]
    k = 0
    while k < len(held):
        stop = k
        while stop < len(held) and runs[stop]:
            stop += 1
        run = [u[0] for u in held[k:stop]]
        if len(run) >= 2 and is_verse(run, ordinary):
            yield Unit(run, True)
        else:
            stop = max(stop, k + 1)
            yield from map(unit, held[k:stop])
        k = stop


# rows of lists


@dataclass
class Row:
    """What a line is among its document's lines: an item of a list or of definitions, or centred by hand."""

    col: float
    lead: int
    text: str
    kind: str | None = None
    marker: str | None = None
    label: str | None = None
    item: str | None = None
    level: int = 0
    centred: str | None = None  #: ``tag`` or ``spaces``


MEASURE = 65
_definition = re.compile(r"^(\S+:)( {2,})(\S.*)$")


def structure(entries: list[tuple[float, float, str, str] | None], replaced: str = "") -> list[Row | None]:
    """Rows for entries of (indent, cut on the right, alignment, text); a null is a break, at which nesting ends.

    A glyph is a bullet where it opens lines at one column at least twice and isn't in the text after it; those in
    ``replaced`` are none, as they stand for letters that the text's encoding lacked. Levels are a stack of columns. A
    line is centred if its block is, or if its padding is as wide on both sides."""
    rows: list[Row | None] = []
    for e in entries:
        if e is None:
            rows.append(None)
            continue
        text = e[3].lstrip(" ")
        lead = len(e[3]) - len(text)
        rows.append(Row(e[0] + lead, lead, text))
    bulleted = lambda t: len(t) > 2 and t[1] == " " and t[2] != " " and not t[0].isalnum() and t[0] not in t[2:] and t[0] not in replaced
    seen_at = Counter((r.col, r.text[0]) for r in rows if r and bulleted(r.text))
    for r in rows:
        if r and bulleted(r.text) and seen_at[r.col, r.text[0]] >= 2:
            r.kind, r.marker, r.item = "bullet", r.text[0], r.text[2:]
        elif r and (m := _definition.match(r.text)):
            r.kind, r.label, r.item = "def", m[1], m[3]
    leads = Counter(r.lead for r in rows if r and r.kind is None and r.lead >= 2 and r.text)
    body, n = leads.most_common(1)[0] if leads else (None, 0)
    stack: list[float] = []
    for e, r in zip(entries, rows, strict=True):
        if r is None:
            stack = []
            continue
        while stack and stack[-1] > r.col:
            stack.pop()
        if r.kind and stack[-1:] != [r.col]:
            stack.append(r.col)
        r.level = len(stack)
        content = r.text.rstrip(" ")
        if not content:
            continue
        if e[2] == "center":
            r.centred = "tag"
        elif e[2] == "left" and r.lead >= 2 and not (n >= 3 and r.lead == body) and len(re.findall(r" {3,}", content)) < 2:
            free = MEASURE - e[0] - e[1] - len(content)
            r.centred = "spaces" if free >= 4 and abs(r.lead - free / 2) <= 1.5 else None
    return rows


def block_rows(body: Body, replaced: str = "") -> dict[int, list[tuple[list[Span], Row]]]:
    """Rows of the blocks that flow: no headings, columns, quotations or lines placed by hand."""
    entries: list[tuple[float, float, str, str] | None] = []
    plan: list[tuple[int, list[Span]] | None] = []
    for k, b in enumerate(body.blocks):
        if b.kind != "para" or b.heading or (b.look.columns or 0) > 1 or b.quote or not b.look.wrap:
            if b.kind != "condpage":
                entries.append(None)
                plan.append(None)
            continue
        for line in logical(b):
            entries.append((b.look.left or 0, max(0, MEASURE - b.look.right) if b.look.right else 0, b.look.align, "".join(s.text for s in line)))
            plan.append((k, line))
    out: dict[int, list[tuple[list[Span], Row]]] = {}
    for at, row in zip(plan, structure(entries, replaced), strict=True):
        if at is not None and row is not None:
            out.setdefault(at[0], []).append((at[1], row))
    return out


def sliced(spans: list[Span], start: int, stop: int | None = None) -> list[Span]:
    """The characters from ``start`` to ``stop``, note marks counted."""
    out, at = [], 0
    stop = sum(len(s.text) for s in spans) if stop is None else stop
    for s in spans:
        part = s.text[max(0, start - at) : max(0, stop - at)]
        at += len(s.text)
        if part:
            out.append(s if part == s.text else replace(s, text=part))
    return out


def head_runs(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """Runs of a running head with the styles that its toggles set; an empty list if nothing is visible."""
    out: list[tuple[str, tuple[str, ...]]] = []
    on: set[str] = set()
    for part in re.split(r"([\x00-\x1f])", text.replace("∙", "•")):
        if len(part) == 1 and part < " ":
            on ^= {t for t, code in wordfile.TOGGLE_OF.items() if code == ord(part)}
        elif part:
            out.append((part, tuple(sorted(on))))
    return out if any(t.strip() for t, _ in out) else []


def entries_shown(entries: list[tuple[str, int]], pages: dict[int, int] | None) -> list[str]:
    """Entries of contents or index: a number sign becomes the page; without pages it goes; with none the page follows."""
    out = []
    for text, block in entries:
        page = (pages or {}).get(block)
        if pages is None:
            out.append(text.replace("#", "").rstrip())
        else:
            out.append(text.replace("#", "" if page is None else str(page)) if "#" in text or page is None else f"{text} {page}")
    return out


# the fold as a table

_LINE = {"text": pa.string(), "soft": pa.bool_(), "lead": pa.float64(), "refs": pa.list_(pa.int32())}
_BLOCK = {"kind": pa.string(), "origin": pa.string(), "need": pa.int32(), "align": pa.string(), "wrap": pa.bool_(), "left": pa.float64(), "right": pa.float64(), "para": pa.float64(), "columns": pa.int32(), "gutter": pa.float64(), "tabs": pa.list_(pa.float64()), "style": pa.string(), "heading": pa.int32(), "quote": pa.bool_(), "trailing": pa.int32()}
_TABLES = {
    "notes": {"note_ix": pa.int32(), "kind": pa.string(), "text": pa.string(), "origin": pa.string()},
    "toc": {"level": pa.int32(), "entry": pa.string(), "block_ix": pa.int32()},
    "index": {"entry": pa.string(), "block_ix": pa.int32()},
    "heads": {"place": pa.string(), "n": pa.int32(), "text": pa.string(), "block_ix": pa.int32()},
    "commands": {"block_ix": pa.int32(), "line_ix": pa.int32(), "text": pa.string()},
    "styles": {"slot": pa.int32(), "name": pa.string(), "heading": pa.int32(), "align": pa.string()},
}
_SQL = {pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.int32(): "int", pa.list_(pa.float64()): "array<double>", pa.list_(pa.int32()): "array<int>"}
_struct = lambda fields, more="": "struct<" + ",".join(f"{n}:{_SQL[t]}" for n, t in fields.items()) + more + ">"
SCHEMA = f"doc_id long, blocks array<{_struct(_BLOCK, f',lines:array<{_struct(_LINE)}>')}>, " + ", ".join(f"`{n}` array<{_struct(t)}>" for n, t in _TABLES.items()) + ", includes array<string>, page map<string,double>, settings string, error struct<kind:string,message:string>"


def read_blocks(files: DataFrame, encoding: str = "cp437", variant: str | None = None, partitions: int | None = None) -> DataFrame:
    """``doc_id, content`` to the blocks of each document and what its commands collected: one row, arrays of structs.
    ``page`` has the page values that the document sets; ``settings`` is JSON. What can't be read has an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wordfile.portions(batches):
            found = [wordfile.parsed(b, encoding, variant) for b in part.column("content").to_pylist()]
            bodies = [body_of(d) if isinstance(d, Document) else Body() for d in found]
            held = [b.blocks for b in bodies]
            flat = [b for x in held for b in x]
            lines = wordfile.structs([[("".join(s.text for s in x.spans if s.ref is None), x.soft, x.lead, [s.ref for s in x.spans if s.ref is not None]) for x in b.lines] for b in flat], _LINE)
            rows = [(b.kind, b.origin, b.need, b.look.align, b.look.wrap, b.look.left, b.look.right, b.look.para, b.look.columns, b.look.gutter, list(b.look.tabs), b.name, b.heading, b.quote, trailing_blanks(b)) for b in flat]
            columns = list(zip(*rows, strict=True)) or [()] * len(_BLOCK)
            block = pa.StructArray.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _BLOCK.values(), strict=True)), lines], names=[*_BLOCK, "lines"])
            ends = [0]
            for x in held:
                ends.append(ends[-1] + len(x))
            tables = {
                "notes": [[(k, n.kind, n.text, n.origin) for k, n in enumerate(b.notes)] for b in bodies],
                "toc": [b.toc for b in bodies],
                "index": [b.index for b in bodies],
                "heads": [b.heads for b in bodies],
                "commands": [b.commands for b in bodies],
                "styles": [[(r["slot"], r["name"], heading_level(r["name"]), r.get("align")) for r in d.styles] if isinstance(d, Document) else [] for d in found],
            }
            out = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), block)]
            out += [wordfile.structs(rows, _TABLES[n]) for n, rows in tables.items()]
            out += [pa.array([b.includes for b in bodies], pa.list_(pa.string())), pa.array([list(b.page.items()) for b in bodies], pa.map_(pa.string(), pa.float64())), pa.array([json.dumps(b.settings, sort_keys=True) for b in bodies])]
            out.append(pa.array([None if isinstance(d, Document) else {"kind": d.kind, "message": str(d)} for d in found], pa.struct([("kind", pa.string()), ("message", pa.string())])))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "blocks", *tables, "includes", "page", "settings", "error"])

    return wordfile.spread_files(files, partitions).mapInArrow(read, SCHEMA)
