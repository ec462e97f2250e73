"""Output formats: a registry of functions of one document, applied to a table in one pass.

Modern mode reflows logical lines into paragraphs; printed mode keeps every physical line. A print stream is always
printed, whatever is asked for. Emitters read blocks (``blocks.body_of``), so what commands set reaches every format.
"""

from __future__ import annotations

import base64
import html as _html
import json
import re
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points

import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks, printed, settings, wordfile
from .blocks import Block, Body, body_of
from .printed import PageLine
from .wordfile import Document, Span

Emitter = Callable[..., str | bytes]
#: Name: the function, the extension of its files, whether it gives bytes.
_registry: dict[str, tuple[Emitter, str, bool]] = {}
NOTE_KINDS = ("footnote", "endnote", "annotation", "comment")
DEFAULT_NOTES = NOTE_KINDS[:3]  # comments appear only when they are asked for


def emitter(name: str, extension: str, aliases: tuple[str, ...] = (), binary: bool = False) -> Callable[[Emitter], Emitter]:
    """Registers a format: a function of a document, a mode and options, to text or (``binary``) bytes."""

    def register(f: Emitter) -> Emitter:
        for n in (name, *aliases):
            _registry[n] = (f, extension, binary)
        return f

    return register


def load_plugins(group: str = "palimpsest.emitters") -> None:
    for point in entry_points(group=group):
        point.load()


def get_emitter(name: str) -> Emitter:
    try:
        return _registry[name][0]
    except KeyError:
        raise ValueError(f"no format {name!r}; there are {', '.join(sorted(_registry))}") from None


def formats() -> dict[str, str]:
    return {name: extension for name, (_, extension, _) in _registry.items()}


def effective_mode(doc: Document, mode: str) -> str:
    columnar = doc.variant == "printstream" or (doc.variant == "ws4" and any(re.match(r"^\.r.*!", x.text, re.I) for x in doc.lines))
    return "printed" if columnar else mode


def labels(notes: list[wordfile.Note], scheme: str = "word", starts: dict | None = None) -> list[tuple[str, str]]:
    """Label and shown mark of each note; ranks are over all notes."""
    ranks, out = dict.fromkeys(NOTE_KINDS, 0), []
    for n in notes:
        ranks[n.kind] += 1
        k = ranks[n.kind]
        start = (starts or {}).get(f"{n.kind}_start", 1)
        counted = n.kind in ("footnote", "endnote")
        label = str((k - 1 if n.number is None else n.number) + start) if counted else (n.tag or str(k)) if n.kind == "annotation" else str(k)
        prefixed = {"endnote": f"e{label}", "annotation": f"a{k}", "comment": f"c{k}"}.get(n.kind, label)
        word = {"endnote": roman(int(label)) if n.kind == "endnote" else "", "comment": f"c{k}"}.get(n.kind, label)
        out.append((label, prefixed if scheme == "prefixed" else word))
    return out


def roman(n: int) -> str:
    if n <= 0:
        return str(n)
    out = ""
    for value, digits in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + digits * (n // value), n % value
    return out


def slug(label: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "-", label).strip("-") or "0"


class View:
    """What an emitter needs of a document: its blocks, its notes with labels, the kinds to keep, its paragraphs."""

    def __init__(self, doc: Document, mode: str, notes: tuple[str, ...], note_refs: str = "word", page: dict[str, float] | None = None):
        self.doc, self.body = doc, body_of(doc, page)
        self.printed = effective_mode(doc, mode) == "printed"
        self.keep = {k for k in notes if k != "comment"} if self.printed else set(notes)
        self.scheme = note_refs
        self.labels = labels(self.body.notes, note_refs, self.body.settings)
        self.kept = {k for k, n in enumerate(self.body.notes) if n.kind in self.keep}
        self.convention = self.body.convention
        self.front = self.body.front_matter(self.convention)
        self.scenes = set() if self.printed else self.body.scenes

    def note(self, ref: int) -> tuple[wordfile.Note, str, str]:
        return (self.body.notes[ref], *self.labels[ref])

    def units(self, k: int, lines: list[list[Span]] | None = None, opening: bool = True) -> Iterator[blocks.Unit]:
        b = self.body.blocks[k]
        return blocks.paragraphs(blocks.logical(b) if lines is None else lines, b.look.wrap, self.doc.margin or 65, opening and self.front[k], self.convention if opening else None, k in self.scenes)

    def listed(self) -> Iterator[tuple[str, list[tuple[int, str, wordfile.Note]]]]:
        """Kind by kind: place, label and note."""
        for kind in NOTE_KINDS:
            held = [(k, self.labels[k][0], n) for k, n in enumerate(self.body.notes) if n.kind == kind and kind in self.keep]
            if held:
                yield kind, held

    def contents(self, pages: dict[int, int] | None = None) -> tuple[list[tuple[int, str]], list[str]]:
        shown = blocks.entries_shown([(t, k) for _, t, k in self.body.toc], pages)
        return [(level, t) for (level, _, _), t in zip(self.body.toc, shown, strict=True)], blocks.entries_shown(self.body.index, pages)


def one_line(unit: blocks.Unit) -> bool:
    return len(unit.lines) > 1 and not unit.kept


def _plain_contents(view: View) -> list[str]:
    toc, index = view.contents()
    out = ["TABLE OF CONTENTS", "", *("  " * max(0, level - 1) + t for level, t in toc), ""] if toc else []
    return out + (["INDEX", "", *index] if index else [])


def aligned(lines: list[str], b: Block) -> list[str]:
    """Centred and right-aligned lines padded in the block's measure."""
    if b.look.align not in ("center", "right"):
        return lines
    out = []
    for line in lines:
        free = printed.text_width(b) - len(line.strip())
        pad = max(0, free // 2 if b.look.align == "center" else free)
        out.append(" " * pad + line.strip() if line.strip() else line)
    return out


@emitter("text", "txt", ("txt",))
def text(doc: Document, mode: str = "modern", notes: tuple[str, ...] = DEFAULT_NOTES, toc: bool = False, **_) -> str:
    view = View(doc, mode, notes)

    def say(spans: list[Span]) -> str:
        out = []
        for s in spans:
            if s.width is not None:
                out.append(" " * round(s.width / 180) if view.printed else "")
            elif s.ref is None:
                out.append(s.text)
            elif s.ref in view.kept and view.body.notes[s.ref].kind != "comment":
                out.append(f"[{view.labels[s.ref][0]}]")
        return "".join(out)

    out: list[str] = []
    for k, b in enumerate(view.body.blocks):
        if b.kind == "pagebreak":
            out.append("\f" if mode == "printed" else "\n" + "-" * 20 + "\n")
        elif b.kind == "condpage":
            continue
        elif view.printed:
            said = "\n".join(aligned([say(x.spans) for x in b.lines], b))
            out += [said] if said.strip() or mode == "printed" else []
        else:
            for unit in view.units(k):
                rows = [say(x) for x in unit.lines]
                if one_line(unit):
                    rows = [" ".join(r for r in [rows[0], *(x.lstrip(" ") for x in rows[1:])] if r.strip())]
                rows = aligned(rows, b)
                if b.quote:
                    rows = ["    " + r.lstrip(" ") if r.strip() else r for r in rows]
                out += ["\n".join(rows)] if any(r.strip() for r in rows) else []
    said = "\n".join(out) if view.printed else "\n\n".join(x for x in out if x.strip())
    for kind, held in view.listed():
        said += f"\n\n{kind.title()}s:\n" + "\n".join(f"[{label}] {n.text}" for _, label, n in held)
    if toc and (rows := _plain_contents(view)):
        said += "\n\n" + "\n".join(rows)
    return said + "\n"


_MARKS = {"b": ("**", "**"), "i": ("*", "*"), "strike": ("~~", "~~"), "u": ("<u>", "</u>"), "sup": ("<sup>", "</sup>"), "sub": ("<sub>", "</sub>")}
_PREFIX = {"footnote": "", "endnote": "e", "annotation": "a", "comment": "c"}


@emitter("markdown", "md", ("md",))
def markdown(doc: Document, mode: str = "modern", notes: tuple[str, ...] = DEFAULT_NOTES, toc: bool = False, pictures: dict[int, str] | None = None, **_) -> str:
    """``pictures``: links of graphics by their place."""
    view = View(doc, mode, notes)
    known = lambda k: _PREFIX[view.body.notes[k].kind] + slug(view.labels[k][0])

    def say(b: Block, span: Span, plain: bool) -> str:
        if span.width is not None:
            return ""
        if span.pix is not None and span.pix in (pictures or {}):
            name = re.split(r"[/\\]", doc.graphics[span.pix])[-1] or doc.graphics[span.pix]
            return f"![{re.sub(r'([][])', r'\\\1', name)}]({pictures[span.pix]})"
        if span.ref is not None:
            return f"[^{known(span.ref)}]" if span.ref in view.kept else ""
        if not span.text.strip():
            return span.text
        core = span.text.strip()
        lead, _, trail = span.text.partition(core)
        core = re.sub(r"([\\*_#`\[\]])", r"\\\1", core)
        for style in () if plain else b.styles(span):
            before, after = _MARKS.get(style, ("", ""))
            core = before + core + after
        return lead + core + trail

    def row(b: Block, spans: list[Span]) -> str:
        raw = "".join(s.text for s in spans)
        plain = 0 < len(raw.strip()) <= 5 and not any(map(str.isalpha, raw))  # a letterless marker
        return "".join(say(b, s, plain) for s in spans).lstrip(" ")

    def heads() -> str:
        rows = [f"# {r}" if r in ("TABLE OF CONTENTS", "INDEX") else r for r in _plain_contents(view) if r]
        return "\n\n".join(rows) if toc else ""

    if view.printed:
        fenced = text(doc, "printed", notes).rstrip("\n")
        return f"```\n{fenced}\n```\n" + (f"\n{heads()}\n" if heads() else "")
    out: list[str] = []
    for k, b in enumerate(view.body.blocks):
        if b.kind == "pagebreak":
            out.append("---")
        elif b.heading:
            said = "  \n".join(row(b, x) for x in blocks.logical(b)).strip()
            out += ["#" * b.heading + " " + said] if said else []
        elif b.kind == "para":
            for unit in view.units(k):
                rows = [row(b, x) for x in unit.lines]
                if not any(r.strip() for r in rows):
                    continue
                rows = [" ".join(r for r in rows if r.strip())] if one_line(unit) else rows
                out.append("\n".join(f"> {r}" if r else ">" for r in rows) if b.quote else "  \n".join(rows))
    said = "\n\n".join(out)
    defined = [f"[^{known(k)}]: " + "\n".join(x.lstrip(" ").replace("\\", "\\\\") for x in n.text.split("\n")) for k, n in enumerate(view.body.notes) if k in view.kept]
    said += "\n\n" + "\n".join(defined) if defined else ""
    return said + (f"\n\n{heads()}" if heads() else "") + "\n"


#: Fixed: element of each style, prefixes of note ids, the sixteen colours.
_TAGS = {"b": "strong", "i": "em", "u": "u", "sup": "sup", "sub": "sub", "strike": "s"}
_IDS = {"footnote": "fn", "endnote": "en", "annotation": "an", "comment": "cm"}
_ALIGN = ("center", "right", "justify")
VERSE_LEAD = 1.2
_SHEET = """body{margin:0;padding:2rem 1rem;font:14pt/1.6 Georgia,serif;color:#222}
p{margin:0 0 1em}
.ws-native{white-space:pre-wrap;font:14px/1.5 ui-monospace,Consolas,monospace}
span.ws-graphic{font-family:ui-monospace,Consolas,monospace}
hr.pb{border:none;border-top:1px dashed #bbb;margin:2rem 0}
blockquote{margin:1em 2em;padding-left:1em;border-left:2px solid #ccc}
blockquote p{margin:0}"""


def _colour(n: int) -> tuple[int, int, int]:
    """Sixteen colours: three bits and a bright one; the sixth is brown."""
    if n % 16 == 6:
        return 170, 85, 0
    return tuple(170 * (n >> k & 1) + 85 * (n >> 3 & 1) for k in (2, 1, 0))


def _style_name(record: dict) -> str:
    return f"ws-{record['slot']}-{re.sub(r'[^a-z0-9]+', '-', record['name'].lower()).strip('-') or 'style'}"


def _style_rules(doc: Document, view: View) -> list[str]:
    rules = []
    for r in doc.styles:
        if "attrs" not in r:
            continue
        lines = [d for tag, d in (("u", "underline"), ("strike", "line-through")) if tag in r["attrs"]]
        props = [f"text-align:{r['align']}"] if r.get("align") else []
        props += [f"margin-{side}:{r[side] / 1800:.2f}in" for side in ("left", "right") if view.printed and r.get(side)]
        props += ["font-weight:bold"] if "b" in r["attrs"] else []
        props += ["font-style:italic"] if "i" in r["attrs"] else []
        props += ["text-decoration:" + " ".join(lines)] if lines else []
        props += [f"vertical-align:{dict(sub='sub', sup='super')[t]};font-size:smaller" for t in ("sub", "sup") if t in r["attrs"]][:1]
        props += [f"font-size:{r['font'][1] / 20:.4g}pt"] if r.get("font") and r["font"][1] else []
        rules += [f".{_style_name(r)} {{ {'; '.join(props)} }}"] if props else []
    rules += [f".ws-font-{k} {{ font-size:{f['height_vmi'] / 20:.4g}pt }}" for k, f in enumerate(doc.fonts) if f["height_vmi"]]
    used = sorted({s.colour for b in view.body.blocks for x in b.lines for s in x.spans if s.colour is not None})
    return rules + [".ws-colour-%d { color:#%02x%02x%02x }" % (n, *_colour(n)) for n in used]


class Lists:
    """Nested lists from a stream of rows: a deeper level opens a list inside the item before, a shallower one closes."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.open: list[tuple[int, str]] = []  # level and element of each list that is open

    def close(self, level: int = 0, kind: str | None = None) -> None:
        """Closes the lists that are deeper, and one of this level that is of another kind."""
        while self.open and (self.open[-1][0] > level or (self.open[-1][0] == level and self.open[-1][1] != kind) or not level):
            _, tag = self.open.pop()
            self.out.append("</li></ul>" if tag == "ul" else "</dd></dl>")

    def add(self, said: str) -> None:
        if said.strip():
            self.close()
            self.out.append(said + "\n")

    def item(self, level: int, tag: str, said: str) -> None:
        self.close(level, tag)
        if self.open and self.open[-1] == (level, tag):
            self.out.append("</li>" if tag == "ul" else "</dd>")
        else:
            self.out.append(f"<{tag}>")
            self.open.append((level, tag))
        self.out.append(said)


@emitter("html", "html", ("htm",))
def html(doc: Document, mode: str = "modern", notes: tuple[str, ...] = DEFAULT_NOTES, toc: bool = False, note_refs: str = "word", title: str = "", pictures: dict[int, tuple] | None = None, styles: bool = True, replaced: str = "", **_) -> str:
    """``pictures``: by place a link or PNG bytes, and the width and height in inches if they are known. ``replaced``: what a
    lossy encoding wrote for letters it lacks; lines that open with it are no items of lists."""
    view = View(doc, mode, notes, note_refs)
    prefixed = note_refs == "prefixed" and not view.printed
    records = {r["slot"] for r in doc.styles if "attrs" in r} if styles else set()

    def mark(ref: int) -> str:
        note, label, shown = view.note(ref)
        if ref not in view.kept or (note.kind == "comment" and not prefixed):
            return ""
        at = _IDS[note.kind]
        return f'<sup><a id="{at}ref{slug(label)}" href="#{at}{slug(label)}" role="doc-noteref">{_html.escape(shown if prefixed else label)}</a></sup>'

    def picture(span: Span) -> str:
        source, wide, high = (*pictures[span.pix], None, None)[:3]
        name = re.split(r"[/\\]", doc.graphics[span.pix])[-1] or doc.graphics[span.pix]
        link = "data:image/png;base64," + base64.b64encode(source).decode() if isinstance(source, bytes) else _html.escape(source)
        size = f' style="width:{wide:.3f}in;height:{high:.3f}in"' if wide and high else ""
        return f'<img src="{link}" alt="{_html.escape(name)}"{size}>'

    def say(s: Span, verbatim: bool) -> str:
        if s.width is not None:
            return " " * round(s.width / 180) if verbatim else ""
        if s.pix is not None and s.pix in (pictures or {}):
            return picture(s)
        if s.ref is not None:
            return mark(s.ref)
        said = _html.escape(s.text)
        if not verbatim and said.startswith(blocks.OPENING):
            bare = said.lstrip()
            said = "&nbsp;" * (len(said) - len(bare)) + bare
        for style in s.styles:
            said = f"<{_TAGS[style]}>{said}</{_TAGS[style]}>" if style in _TAGS else said
        graphic = s.text.replace(" ", "")
        names = [f"ws-font-{s.font}"] * (s.font is not None) + [f"ws-colour-{s.colour}"] * (s.colour is not None) + ["ws-graphic"] * bool(graphic and all("─" <= c <= "▟" for c in graphic))
        return f'<span class="{" ".join(names)}">{said}</span>' if names else said

    def line(spans: list[Span], verbatim: bool = False) -> str:
        pieces = (wordfile.Span(**{**vars(s), "text": p}) if s.ref is None else s for s in blocks.coalesced(spans) for p in (re.findall(r"[─-▟]+|[^─-▟]+", s.text) if s.ref is None else [s.text]))
        return "".join(say(s, verbatim) for s in pieces)

    def named(b: Block, extra: str = "") -> str:
        names = ([_style_name(b.style)] if b.style and b.style["slot"] in records else []) + ([extra] if extra else [])
        return f' class="{" ".join(names)}"' if names else ""

    flow, quoted = Lists(), []
    quote_indent: int | None = None
    rows = {} if view.printed else blocks.block_rows(view.body, replaced)

    def unquote() -> None:
        nonlocal quote_indent
        if quoted:
            flow.add("<blockquote>" + "".join(quoted) + "</blockquote>")
        quoted.clear()
        quote_indent = None

    def prose(k: int, b: Block, lines: list[list[Span]], opening: bool) -> None:
        nonlocal quote_indent
        align = blocks.trimmed if b.look.align in ("center", "right") else list
        for unit in view.units(k, lines, opening):
            first = align(unit.lines[0])
            wide = blocks.indent(first)
            if b.quote:
                quote_indent = wide if quote_indent is None else quote_indent
                wide = quote_indent
            rest = [align(x) if unit.kept else blocks.without_indent(align(x)) for x in unit.lines[1:]]
            said = [line(x) for x in (blocks.without_indent(first), *rest)]
            para = " ".join(x for x in said if x.strip()) if one_line(unit) else "<br>\n".join(said)
            if not para.strip():
                continue
            tight = (unit.kept and len(unit.lines) > 1) or b.look.align == "center"
            props = [f"text-align:{b.look.align}"] * (b.look.align in _ALIGN) + [f"text-indent:{wide}ch"] * bool(wide) + [f"line-height:{VERSE_LEAD}"] * tight
            look = f' style="{";".join(props)}"' if props else ""
            made = f"<p{named(b)}{look}>{para}</p>"
            if (b.look.columns or 0) > 1:
                gap = f"; column-gap:{b.look.gutter / 10:.2f}in" if b.look.gutter else ""
                made = f'<div style="column-count:{b.look.columns}{gap}">{made}</div>'
            quoted.append(made) if b.quote else flow.add(made)

    for k, b in enumerate(view.body.blocks):
        if b.kind == "pagebreak":
            unquote()
            flow.add('<hr class="pb">')
        elif b.kind == "condpage":
            continue
        elif b.heading:
            unquote()
            said = " ".join(line(blocks.trimmed(x) if b.look.align in ("center", "right") else x) for x in blocks.logical(b)).strip()
            flow.add(f"<h{b.heading}{named(b)}>{said}</h{b.heading}>" if said else "")
        elif view.printed:
            said = "<br>\n".join(line(x.spans, True) for x in b.lines)
            flow.add(f"<p{named(b, 'ws-native')}>{said}</p>" if said.strip() else "")
        else:
            if not b.quote:
                unquote()
            held: list[list[Span]] = []
            opening = True
            for spans, row in rows.get(k) or [(x, None) for x in blocks.logical(b)]:
                if row is None or (row.kind is None and row.centred != "spaces"):
                    held.append(spans)
                    continue
                if held:
                    prose(k, b, held, opening)
                held, opening = [], False
                unquote()
                raw = "".join(s.text for s in spans)
                lead = len(raw) - len(raw.lstrip(" "))
                tail = lambda: line(blocks.sliced(spans, len(raw) - len(row.item)))  # noqa: B023, E731
                if row.kind == "bullet":
                    flow.item(row.level, "ul", f"<li{named(b)}>{tail()}")
                elif row.kind == "def":
                    flow.item(row.level, "dl", f"<dt{named(b)}>{line(blocks.sliced(spans, lead, lead + len(row.label)))}</dt><dd{named(b)}>{tail()}")
                else:
                    flow.add(f'<p{named(b)} style="text-align:center;line-height:{VERSE_LEAD}">{line(blocks.sliced(spans, lead, len(raw.rstrip(" "))))}</p>')
            if held:
                prose(k, b, held, opening)
    unquote()
    flow.close()
    parts = flow.out
    sections = []
    for kind, held in view.listed():
        items = []
        for _k, label, n in held:
            tag = f' data-note-tag="{_html.escape(n.tag)}"' if n.tag else ""
            back = f' <a href="#{_IDS[kind]}ref{slug(label)}" role="doc-backlink">↩</a>' if kind != "comment" or prefixed else ""
            items.append(f'<li id="{_IDS[kind]}{slug(label)}" data-note-kind="{kind}"{tag}>{_html.escape(n.text)}{back}</li>')
        sections.append(f'<section role="doc-endnotes" aria-labelledby="{kind}s-label"><h2 id="{kind}s-label">{kind.title()}s</h2><ol>{"".join(items)}</ol></section>\n')
    said = "".join(parts) + ("<hr>\n" + "".join(sections) if sections else "")
    if toc:
        entries, index = view.contents()
        if entries:
            said += '<nav aria-label="Table of Contents"><h2>Table of Contents</h2><ol>' + "".join(f'<li style="margin-left:{max(0, level - 1) * 1.5}em">{_html.escape(t)}</li>' for level, t in entries) + "</ol></nav>\n"
        if index:
            said += '<section aria-label="Index"><h2>Index</h2><ul>' + "".join(f"<li>{_html.escape(t)}</li>" for t in index) + "</ul></section>\n"
    sheet = "\n".join([_SHEET, *(_style_rules(doc, view) if styles else [])])
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{_html.escape(title)}</title><style>{sheet}</style></head>\n<body>\n{said}</body></html>\n'


def rtf_text(s: str) -> str:
    out = []
    for c in s:
        if c in "\\{}":
            out.append("\\" + c)
        elif ord(c) < 128:
            out.append(c)
        else:
            units = c.encode("utf-16-le")
            out += [f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2)]
    return "".join(out)


_CONTROLS = {"b": "\\b ", "i": "\\i ", "u": "\\ul ", "sup": "\\super ", "sub": "\\sub ", "strike": "\\strike "}
_RTF_ALIGN = {"center": "\\qc ", "right": "\\qr ", "justify": "\\qj ", "left": "\\ql "}
#: Twips of a column, a line and a 48th of an inch; the inset of a quotation in modern mode.
COLUMN, LINE, FORTY_EIGHTH, INSET = 144, 240, 30, 720


class Paragraphs:
    """RTF paragraphs, with only the properties that differ from the one before."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.now = {"align": "left", "fi": 0, "li": 0, "ri": 0, "sl": 0}

    def put(self, lines: list[str], style: str = "", force: bool = False, **look) -> None:
        said = "\\line ".join(lines)
        if not said.strip() and not force:
            return
        for key, value in look.items():
            if value != self.now[key]:
                self.out.append(_RTF_ALIGN[value] if key == "align" else f"\\sl{value}\\slmult0 " if key == "sl" else f"\\{key}{value} ")
                self.now[key] = value
        self.out.append(f"{style}{said}\\par ")


@emitter("rtf", "rtf")
def rtf(doc: Document, mode: str = "modern", notes: tuple[str, ...] = DEFAULT_NOTES, toc: bool = False, note_refs: str = "word", headers: bool = True, line_numbers: bool = True, styles: bool = True, pictures: dict[int, tuple] | None = None, page: dict[str, float] | None = None, **_) -> str:
    view = View(doc, mode, notes, note_refs, page)
    body, on_paper = view.body, view.printed
    prefixed = note_refs == "prefixed" and not on_paper
    records = {r["slot"]: r for r in doc.styles if "attrs" in r} if styles else {}
    roll = round(body.settings.get("roll", 3.0) * 3)
    blanks_underlined = body.settings.get("ul", True) or not on_paper

    def note(ref: int) -> str:
        n, label, shown = view.note(ref)
        if ref not in view.kept:
            return ""
        if n.kind == "comment":
            own = f"{{\\super {rtf_text(shown)}}}" if prefixed else ""
            return f"{own}{{\\chatn}}{{\\*\\atnid palimpsest}}{{\\*\\annotation \\pard\\plain\\fs24 {rtf_text(n.text)}}}"
        own = shown if prefixed and n.kind == "endnote" else shown if prefixed and n.kind == "annotation" else label if n.kind == "annotation" else None
        at_end = "\\ftnalt" if n.kind != "footnote" else ""
        sign = "\\chftn" if own is None else rtf_text(own)
        first = "{\\chftn}" if own is None else f"{{\\super {sign}}}"
        return f"{first}{{\\*\\footnote{at_end} \\pard\\plain\\fs24 {{\\super {sign} }}{rtf_text(n.text)}}}"

    def say(s: Span, b: Block) -> str:
        if s.ref is not None:
            return note(s.ref)
        if s.width is not None:
            return "{" + " " * round(s.width / 180) + "}" if on_paper else ""
        if s.pix is not None and s.pix in (pictures or {}) and isinstance(pictures[s.pix][0], bytes):
            png, wide, high = (*pictures[s.pix], None, None)[:3]
            goal = f"\\picwgoal{round(wide * 1440)}\\pichgoal{round(high * 1440)}" if wide and high else ""
            return f"{{\\pict\\pngblip{goal} {png.hex()}}}"
        own = b.styles(s)

        def controls(tags: tuple[str, ...]) -> str:
            out = "".join(_CONTROLS.get(t, "") for t in tags)
            out += f"\\up{roll} " if on_paper and "sup" in tags else f"\\dn{roll} " if on_paper and "sub" in tags else ""
            out += f"\\fs{round(doc.fonts[s.font]['height_vmi'] / 10)} " if s.font is not None and doc.fonts[s.font]["height_vmi"] else ""
            out += f"\\cf{s.colour % 16 + 1} " if s.colour is not None else ""
            graphic = s.text.replace(" ", "")
            return out + ("\\f1 " if graphic and all("─" <= c <= "▟" for c in graphic) else "")

        if "u" in own and not blanks_underlined and " " in s.text.strip():
            bare = tuple(t for t in own if t != "u")
            return "".join(f"{{{controls(bare if p.isspace() else own)}{rtf_text(p)}}}" for p in re.findall(r" +|[^ ]+", s.text))
        return f"{{{controls(own)}{rtf_text(s.text)}}}"

    def row(spans: list[Span], b: Block) -> str:
        return "".join(say(p, b) for s in blocks.coalesced(spans) for p in ([s] if s.ref is not None else [wordfile.Span(**{**vars(s), "text": t}) for t in re.findall(r"[─-▟]+|[^─-▟]+", s.text)]))

    def margins(b: Block) -> tuple[int, int]:
        if not on_paper:
            return (INSET, INSET) if b.quote else (0, 0)
        r = b.style or {}
        own = [round(r[k] / 1800 * 1440) if r.get(k) else round((said or 0) * COLUMN) for k, said in (("left", b.look.left), ("right", b.look.right))]
        return own[0], own[1]

    paras, number, quote_indent = Paragraphs(), 0, None
    every = body.settings.get("line_numbers") if on_paper and line_numbers else None
    for k, b in enumerate(body.blocks):
        if b.kind != "para":
            quote_indent = None
            paras.out += ["\\page "] if b.kind == "pagebreak" else []
            continue
        li, ri = margins(b)
        style = f"\\s{b.style['slot'] + 1} " if b.style and b.style["slot"] in records else ""
        large = lambda rows: [f"{{\\b\\fs28 {r}}}" for r in rows]
        if on_paper:
            rows = []
            for x in b.lines:
                number += 1
                mark = f"{{{str(number).rjust(4)}\\tab }}" if every and number % every == 0 and any(s.text.strip() for s in x.spans) else ""
                rows.append(mark + row(x.spans, b))
            lead = (b.lines[0].lead if b.lines else None) or body.value("lh")
            first = 0 if b.look.para is None else round(b.look.para * COLUMN) - li
            paras.put(large(rows) if b.heading else rows, style, True, align=b.look.align, fi=first, li=li, ri=ri, sl=-round(lead * FORTY_EIGHTH))
            continue
        tidy = blocks.trimmed if b.look.align in ("center", "right") else list
        if b.heading:
            quote_indent = None
            paras.put(large([row(tidy(x), b) for x in blocks.logical(b)]), style, align=b.look.align, fi=0, li=li, ri=ri, sl=0)
        else:
            if not b.quote:
                quote_indent = None
            for unit in view.units(k):
                lines = [tidy(x) for x in unit.lines]
                wide = blocks.indent(lines[0])
                if b.quote:
                    quote_indent = wide if quote_indent is None else quote_indent
                    wide = quote_indent
                kept = unit.kept and len(lines) > 1
                rows = [row(blocks.without_indent(lines[0]), b), *(row(x if kept else blocks.without_indent(x), b) for x in lines[1:])]
                rows = [" ".join(r for r in rows if r.strip())] if one_line(unit) else rows
                paras.put(rows, style, align=b.look.align, fi=wide * COLUMN, li=li, ri=ri, sl=round(VERSE_LEAD * 14 * 20) if kept or b.look.align == "center" else 0)
        paras.out += ["\\par "] * blocks.trailing_blanks(b)

    sheet = ""
    if records:
        entries = []
        for r in records.values():
            props = _RTF_ALIGN[r["align"]].strip() if r.get("align") in _ALIGN else ""
            props += "".join(f"\\{c}{round(r[side] / 1800 * 1440)}" for c, side in (("li", "left"), ("ri", "right")) if on_paper and r.get(side))
            props += "".join(_CONTROLS[t].strip() for t in ("b", "i", "u", "strike") if t in r["attrs"])
            props += f"\\fs{round(r['font'][1] / 10)}" if r.get("font") and r["font"][1] else ""
            entries.append(f"{{\\s{r['slot'] + 1}{props} {re.sub(r'[\\{}]', '', r['name'])};}}")
        sheet = "{\\stylesheet{\\s0 Normal;}" + "".join(entries) + "}"
    coloured = any(s.colour is not None for b in body.blocks for x in b.lines for s in x.spans)
    table = "{\\colortbl;" + "".join("\\red%d\\green%d\\blue%d;" % _colour(n) for n in range(16)) + "}" if coloured else ""
    running = _rtf_heads(body) if headers else ""
    ending = _rtf_contents(view) if toc else ""
    face = "{\\f0 Times New Roman;}" if on_paper else "{\\f0 Georgia;}"
    return f"{{\\rtf1\\ansi\\deff0{{\\fonttbl{face}{{\\f1 Courier New;}}}}{table}{sheet}{_rtf_page(body, on_paper)}{running}\n{'\\f1\\fs24' if on_paper else '\\f0\\fs28'} \n" + "\n".join(paras.out) + ending + "\n}\n"


def _rtf_page(body: Body, on_paper: bool) -> str:
    """Page size and margins in twips; modern mode takes inches where the file says nothing."""
    height, width = printed.sheet(body) if on_paper or "pl" in body.page else (11.0, 8.5)
    across = on_paper and body.settings.get("orientation") == "landscape"
    height, width = (width, height) if across else (height, width)
    said = lambda name, per, plain: round(body.value(name) * per) if on_paper or name in body.page else plain
    left = said("po", COLUMN, 1440)
    return f"\\paperw{round(width * 1440)}\\paperh{round(height * 1440)}\\margl{left}\\margr{left}\\margt{said('mt', LINE, 1440)}\\margb{said('mb', LINE, 1440)}" + ("\\landscape" if across else "")


def _rtf_heads(body: Body) -> str:
    """The first text of each line of head and foot; a first page of its own where they begin later."""
    first: dict[tuple[str, int], str] = {}
    begins = [at for _, _, text, at in body.heads if text]
    for place, n, text, _ in body.heads:
        if text:
            first.setdefault((place, n), text)
    out = ""
    for place, group in (("head", "header"), ("foot", "footer")):
        rows = []
        for key in sorted(k for k in first if k[0] == place):
            runs = blocks.head_runs(first[key])
            rows += ["".join(f"{{{''.join(_CONTROLS.get(t, '') for t in tags)}{rtf_text(text).replace('#', '{\\chpgn }')}}}" for text, tags in runs)] if runs else []
        out += f"{{\\{group} \\pard\\plain \\f0\\fs22 {'\\line '.join(rows)}\\par}}" if rows else ""
    return "\\titlepg{\\headerf \\pard\\plain\\par}" + out if out and min(begins) > 0 else out


def _rtf_contents(view: View) -> str:
    pages = printed.entry_pages(printed.pages_of(view.body, _shown(view))) if view.printed else None
    toc, index = view.contents(pages)
    title = lambda t: f"{{\\pard\\plain\\qc\\b\\fs28 {t}\\par}}"
    first = [title("TABLE OF CONTENTS"), *(f"{{\\pard\\li{max(0, level - 1) * 360} {rtf_text(t)}\\par}}" for level, t in toc)] if toc else []
    second = [title("INDEX"), *(f"{{\\pard {rtf_text(t)}\\par}}" for t in index)] if index else []
    return "".join(["\\page ", *first, *(["\\page "] if first and second else []), *second]) if toc or index else ""


def _shown(view: View) -> dict[int, str]:
    return {k: view.labels[k][1] for k in sorted(view.kept)}


def flow(view: View, replaced: str = "") -> list[dict]:
    """The stream that a layout is made of: paragraphs with their structure, blank lines, breaks, conditions, heads, tab
    stops, and the notes that don't stand at the foot."""
    body = view.body
    items: list[dict] = []
    ends: dict[int, None] = {}
    tabs: tuple[float, ...] = ()
    for k, b in enumerate(body.blocks):
        if b.kind == "para" and b.look.tabs != tabs:
            tabs = b.look.tabs
            items.append({"kind": "tabs", "stops": list(tabs) or None})
        items += [{"kind": "hf", "which": place[0].upper(), "line": n, "text": text} for place, n, text, at in body.heads if at == k]
        if b.kind != "para":
            items.append({"kind": "break", "origin": "\f" if b.origin == "ff" else ".pa"} if b.kind == "pagebreak" else {"kind": "cond", "lines": b.need})
            continue
        left, cut = b.look.left or 0, max(0, blocks.MEASURE - b.look.right) if b.look.right else 0
        for spans in blocks.logical(b):
            if not spans:
                items.append({"kind": "blank"})
                continue
            spans = blocks.sliced(spans, min(int(left), blocks.indent(spans))) if left and spans[0].ref is None else spans
            spans = blocks.trimmed(spans) if b.look.align in ("center", "right") else spans
            runs, at_foot = [], []
            for s in spans:
                tags = list(b.styles(s, True))
                if s.width is not None:
                    continue
                if s.ref is None:
                    runs.append({"text": s.text, "styles": tags})
                elif s.ref in view.kept:
                    note, label, shown = view.note(s.ref)
                    runs.append({"text": shown if note.kind != "comment" or view.scheme == "prefixed" else "", "styles": tags, "ref": s.ref})
                    if note.kind == "footnote":
                        at_foot.append([s.ref, label])
                    else:
                        ends.setdefault(s.ref)
            items.append({"kind": "para", "align": b.look.align, "indent_cols": left, "cut_cols": cut, "runs": runs, "footnotes": at_foot, "bi": k})
        items += [{"kind": "blank"}] * blocks.trailing_blanks(b)
    if ends:
        items += [{"kind": "blank"}, {"kind": "note-separator"}, *({"kind": "note", "index": k, "label": view.labels[k][1], "text": body.notes[k].text} for k in ends)]
    placed = [x for x in items if x["kind"] in ("para", "break", "cond")]
    rows = blocks.structure([(x["indent_cols"], x["cut_cols"], x["align"], "".join(r["text"] for r in x["runs"])) if x["kind"] == "para" else None for x in placed], replaced)
    for x, r in zip(placed, rows, strict=True):
        if r is not None:
            x["structure"] = {"col": r.col, "level": r.level, "kind": r.kind, "marker": r.marker, "label": r.label, "body": r.item, "centered": r.centred is not None, "center_via": r.centred}
    return items


@emitter("layout", "json", ("json",))
def layout(doc: Document, mode: str = "modern", notes: tuple[str, ...] = DEFAULT_NOTES, note_refs: str = "word", page: dict[str, float] | None = None, replaced: str = "", **_) -> str:
    view = View(doc, "modern", notes, note_refs, page)
    body = view.body
    pages = [
        {
            "lines": [{"segments": [{"text": s.text, "styles": list(s.styles)} for s in x.runs], "soft": x.soft, "overprint": x.over, "cost": x.cost} for x in p.lines],
            "headers": {str(n): t for n, t in sorted(p.heads.items())},
            "footers": {str(n): t for n, t in sorted(p.feet.items())},
            "notes": p.foot,
        }
        for p in printed.pages_of(body, _shown(View(doc, "printed", notes)))
    ]
    listed = [{"kind": n.kind, "label": label, "shown": shown, "text": n.text, "origin": n.origin} for k, n in enumerate(body.notes) for label, shown in [view.labels[k]] if k in view.kept]
    hidden = {"dot_commands": [t for _, _, t in body.commands], "dot_positions": [list(c) for c in body.commands], "hf_events": [list(e) for e in body.heads], "notes": [{"kind": n.kind, "text": n.text, "origin": n.origin} for n in body.notes]}
    meta = {"variant": doc.variant, "release": doc.release, "driver": doc.driver, "margin": doc.margin, "columnar": effective_mode(doc, "modern") == "printed"}
    made = {"version": 1, "meta": meta, "page": {n: body.value(n) for n in blocks.dots.DEFAULTS}, "fonts": doc.fonts, "modern": {"items": flow(view, replaced), "notes": listed}, "printed": {"pages": pages}, "invisibles": hidden}
    return json.dumps(made, ensure_ascii=False, sort_keys=True)


@emitter("diagnose", "json")
def diagnose(doc: Document, mode: str = "modern", notes: tuple[str, ...] = NOTE_KINDS, page: dict[str, float] | None = None, **_) -> str:
    body = body_of(doc, page)
    counts = {k: sum(n.kind == k for n in body.notes) for k in NOTE_KINDS}
    facts = {"variant": doc.variant, "release": doc.release, "driver": doc.driver, "lines": len(doc.lines), "margin": doc.margin, "notes": counts, "fonts": len(doc.fonts), "graphics": doc.graphics, "includes": body.includes}
    facts |= {"paragraphs": sum(b.kind == "para" for b in body.blocks), "page": {n: {"value": body.value(n), "source": body.source(n)} for n in blocks.dots.DEFAULTS}, "formatting": body.settings}
    facts |= {"unknown_blocks": [{"type": f"0x{c:02x}", "offset": at, "length": len(data)} for c, at, data in doc.unknown], "unknown_codes": {f"{k:02x}": v for k, v in sorted(doc.tally.items())}, "dot_commands": [t for _, _, t in body.commands]}
    facts |= {"toc_entries": len(body.toc), "index_entries": len(body.index), "heads": [list(h) for h in body.heads], "columnar": effective_mode(doc, "modern") == "printed"}
    return json.dumps(facts, sort_keys=True)


@emitter("native", "ws", ("ws",), binary=True)
def native(doc: Document, mode: str = "modern", notes: tuple[str, ...] = NOTE_KINDS, **_) -> bytes:
    """The document's own bytes; a line whose spans were edited is written anew from them."""
    if doc.shifted:
        raise ValueError("documents with double-byte runs can't be written back")
    kind = doc.variant
    out = bytearray()
    for line in doc.lines:
        own = wordfile.Reader(line.raw, kind).read() if kind.startswith("ws") else wordfile.read_print(line.raw)
        plain = "".join(x.text for x in own.lines)
        if plain == line.text:
            out += line.raw + line.brk
            continue
        for s in line.spans:
            codes = bytes(wordfile.TOGGLE_OF[t] for t in s.styles if t in wordfile.TOGGLE_OF)
            out += codes + s.text.encode("cp437", "replace") + codes[::-1]
        out += line.brk
    return bytes(out + doc.tail)


@emitter("pdf", "pdf", binary=True)
def pdf(doc: Document, mode: str = "printed", notes: tuple[str, ...] = DEFAULT_NOTES, columns: int = 65, page: dict[str, float] | None = None, **_) -> bytes:
    """Pages of the document's own geometry; in modern mode paragraphs are wrapped anew. ``page`` has the machine's values
    (``settings.page_settings``), which count where the document says nothing."""
    view = View(doc, mode, notes, page=page)
    shown = _shown(view)
    if view.printed:
        return printed.pdf_bytes(printed.pages_of(view.body, shown), view.body)
    made: list[tuple[int, list[PageLine]]] = []
    for k, b in enumerate(view.body.blocks):
        lines: list[PageLine] = []
        if b.kind == "para":
            for unit in view.units(k):
                gathered = [unit.lines[0], *(x if unit.kept else [Span(" "), *blocks.without_indent(x)] for x in unit.lines[1:])]
                for spans in gathered if unit.kept else [[s for x in gathered for s in x]]:
                    lines += [PageLine(printed.padded(b, r), block=k) for r in printed.wrap_runs(printed.marked(spans, shown, b), columns)]
                lines.append(PageLine([], block=k))
        made.append((k, lines))
    return printed.pdf_bytes(printed.pages_of(view.body, shown, made), view.body)


wrap = printed.wrap


def convert_bytes(data: bytes, to: str = "markdown", mode: str = "modern", encoding: str = "cp437", variant: str | None = None, **options) -> str | bytes:
    return get_emitter(to)(wordfile.parse(data, variant, encoding), mode, **settings.checked_options(options | {"mode": mode, "to": to}, ("mode", "to")))


def convert_many(files: DataFrame, to: tuple[str, ...], mode: str = "modern", encoding: str = "cp437", variant: str | None = None, partitions: int | None = None, **options) -> DataFrame:
    """``doc_id, error`` and a column for each format: each document is parsed once. ``error`` is of the reader, or of the
    first format that refused the document; a format that refused it is null."""
    chosen = {name: (get_emitter(name), _registry[name][2]) for name in to}
    asked = settings.checked_options(options | {"mode": mode}, ("mode",))
    error = pa.struct([("kind", pa.string()), ("message", pa.string())])
    schema = ", ".join(["doc_id long", "error struct<kind:string,message:string>", *(f"`{n}` {'binary' if b else 'string'}" for n, (_, b) in chosen.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wordfile.portions(batches, 1 << 20):
            made: dict[str, list] = {name: [] for name in chosen}
            errors: list[dict | None] = []
            for content in part.column("content").to_pylist():
                doc = wordfile.parsed(content, encoding, variant)
                wrong = None if isinstance(doc, Document) else {"kind": doc.kind, "message": str(doc)}
                for name, (f, _) in chosen.items():
                    out = None
                    if isinstance(doc, Document):
                        try:
                            out = f(doc, mode, **asked)
                        except ValueError as e:
                            wrong = wrong or {"kind": "write", "message": str(e)}
                    made[name].append(out)
                errors.append(wrong)
            columns = [pa.array(v, pa.binary() if chosen[n][1] else pa.string()) for n, v in made.items()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(errors, error), *columns], names=["doc_id", "error", *made])

    return wordfile.spread_files(files, partitions).mapInArrow(run, schema)


def convert(files: DataFrame, to: str = "markdown", mode: str = "modern", encoding: str = "cp437", variant: str | None = None, partitions: int | None = None, **options) -> DataFrame:
    """``doc_id, output, error`` for ``doc_id, content``; formats of bytes give binary output."""
    made = convert_many(files, (to,), mode, encoding, variant, partitions, **options)
    return made.select("doc_id", made[to].alias("output"), "error")
