"""Printed pages: lines with their leads fill pages under the margins in force, with notes at the foot and running heads;
and their PDF, drawn in the four faces of a fixed-pitch base font."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cache

from . import blocks
from .blocks import Body
from .geometry import LEAST_BODY, POINTS_A_COLUMN, POINTS_A_LINE, RULE
from .wordfile import Span

FULL = 1_000_000_000


@dataclass
class PageLine:
    runs: list[Span]
    cost: float = 1.0  #: of the document's own lines
    over: bool = False
    block: int = 0
    soft: bool = False


@dataclass
class Page:
    number: int
    lines: list[PageLine] = field(default_factory=list)
    foot: list[str] = field(default_factory=list)
    heads: dict[int, str] = field(default_factory=dict)
    feet: dict[int, str] = field(default_factory=dict)
    mt: float = 3.0
    mb: float = 8.0


def capacity(body: Body, mt: float, mb: float) -> float:
    """Text lines of a page; a length of zero turns page breaks off."""
    pl, lh = body.value("pl"), body.value("lh")
    return FULL if pl == 0 else max(1, int((pl - mt - mb) * 8 / lh))


def margins_by_block(body: Body) -> list[tuple[int, str, float]]:
    """Block, name and value of each .mt and .mb, in order: unlike other page commands they count from their place on."""
    out = []
    for block, _, text in body.commands:
        found = blocks.command(text)
        if found and found[0] in ("mt", "mb") and (value := blocks.page_value(*found)) is not None:
            out.append((block, found[0], value))
    return out


def note_rows(text: str, mark: str, columns: int) -> list[str]:
    return wrap(f"{mark}. {text}", columns)


class Pager:
    """Fills pages. A line brings its notes to the foot of its page behind a rule; what doesn't fit goes on to the next
    page behind a line that says so; ``LEAST_BODY`` lines of the body stay wherever there are that many."""

    def __init__(self, body: Body, start: int):
        self.body, self.pages, self.number = body, [], start
        self.margins = {"mt": body.value("mt"), "mb": body.value("mb")}
        self.room = capacity(body, **self.margins)
        self.heads: dict[int, str] = {}
        self.feet: dict[int, str] = {}
        self.waiting: list[str] = []
        self.page, self.used = self.fresh(), 0.0

    def fresh(self) -> Page:
        return Page(self.number, heads=dict(self.heads), feet=dict(self.feet), **self.margins)

    def close(self) -> None:
        if self.waiting:
            self.page.foot.append("...Continued...")
        self.pages.append(self.page)
        self.number += 1
        self.room = capacity(self.body, **self.margins)
        self.page, self.used = self.fresh(), 0.0
        if self.waiting:
            fits = max(1, int(min(self.room, FULL)) - LEAST_BODY - 2)
            self.page.foot, self.waiting = ["-" * RULE, *self.waiting[:fits]], self.waiting[fits:]

    @property
    def left(self) -> float:
        return self.room - self.used - len(self.page.foot) - bool(self.waiting)

    def state(self, heads: dict[int, str], feet: dict[int, str], margins: dict[str, float]) -> None:
        """What counts from here on; a page that holds nothing yet takes it at once."""
        self.heads, self.feet, self.margins = heads, feet, margins
        if not self.page.lines:
            self.page = replace(self.fresh(), foot=self.page.foot)
            self.room = capacity(self.body, **margins)

    def put(self, line: PageLine, notes: list[list[str]]) -> None:
        cost = 0.0 if line.over else line.cost
        if self.page.lines and cost > self.left + 1e-9:
            self.close()
        self.page.lines.append(line)
        self.used += cost
        for rows in notes:
            if rows and not self.page.foot:
                self.page.foot.append("-" * RULE)
            fits = 0 if self.waiting else max(0, int(min(FULL, self.room - max(self.used, LEAST_BODY) - len(self.page.foot) - 1)))
            self.page.foot += rows[:fits]
            self.waiting += rows[fits:]

    def condition(self, need: int) -> None:
        if self.page.lines and self.left < need:
            self.close()

    def done(self) -> list[Page]:
        while self.waiting:
            self.close()
        if self.page.lines or self.page.foot or not self.pages:
            self.close()
        return self.pages


def pages_of(body: Body, shown: dict[int, str], reflow: list[tuple[int, list[PageLine]]] | None = None, columns: int = 65) -> list[Page]:
    """Pages of a document's physical lines, or of ``reflow``: lines made for each block. ``shown`` has the marks of the
    notes that are printed; footnotes stand at the foot, the others at the end."""
    pager = Pager(body, int(body.value("pn")))
    events, heads, feet = list(body.heads), {}, {}
    margins = margins_by_block(body)
    now = dict(pager.margins)
    made = dict(reflow or [])
    suppress = bool(body.settings.get("sb"))
    lh = body.value("lh")
    at_foot = {k for k in shown if body.notes[k].kind == "footnote"}
    for k, b in enumerate(body.blocks):
        changed = False
        while events and events[0][3] <= k:
            place, n, text, _ = events.pop(0)
            side = heads if place == "head" else feet
            side[n] = text
            changed = True
        while margins and margins[0][0] <= k:
            _, name, value = margins.pop(0)
            now[name] = value
            changed = True
        if changed:
            pager.state({n: t for n, t in heads.items() if t}, {n: t for n, t in feet.items() if t}, dict(now))
        if b.kind == "pagebreak":
            pager.close()
            continue
        if b.kind == "condpage":
            pager.condition(b.need)
            continue
        lines = made.get(k, []) if reflow is not None else [PageLine(padded(b, marked(x.spans, shown, b)), (x.lead or lh) / lh, x.over, k, x.soft) for x in b.lines]
        source = [x.spans for x in b.lines] if reflow is None else [x.runs for x in lines]
        for line, spans in zip(lines, source, strict=True):
            if suppress and not pager.page.lines and not any(s.text.strip() for s in line.runs):
                continue
            notes = [note_rows(body.notes[s.ref].text, shown[s.ref], columns) for s in spans if s.ref in at_foot]
            pager.put(line, notes)
    ends = [(n.kind, shown[k], n.text) for k, n in enumerate(body.notes) if k in shown and k not in at_foot]
    if ends:
        for row in ["", "-" * RULE, *(r for _, mark, text in ends for r in note_rows(text, mark, columns))]:
            pager.put(PageLine([Span(row)]), [])
    return pager.done()


def marked(spans: list[Span], shown: dict[int, str], block: blocks.Block | None = None) -> list[Span]:
    """Note marks as they are shown, print controls as the width that they declare, styles of the block added."""
    out = []
    for s in spans:
        styles = block.styles(s, True) if block else s.styles
        if s.ref is not None:
            if s.ref in shown:
                out.append(replace(s, text=shown[s.ref], styles=tuple(sorted({*styles, "sup"}))))
        elif s.width is not None:
            out.append(replace(s, text=" " * round(s.width / 180)))
        else:
            out.append(replace(s, styles=styles))
    return out


def padded(block: blocks.Block, runs: list[Span]) -> list[Span]:
    """Runs of a centred or right-aligned block, behind the padding that puts them there."""
    if block.look.align not in ("center", "right") or not any(s.text.strip() for s in runs):
        return runs
    runs = blocks.trimmed(runs)
    free = text_width(block) - sum(len(s.text) for s in runs)
    n = max(0, free // 2 if block.look.align == "center" else free)
    return [Span(" " * n), *runs] if n else runs


def text_width(block: blocks.Block) -> int:
    right = block.look.right if block.look.right and block.look.right > 0 else blocks.MEASURE
    return int(right + (block.look.left or 0) + 1)


def wrap(row: str, columns: int) -> list[str]:
    """Greedy wrap at spaces; the spaces at a break are dropped, and a longer word is cut."""
    out, held = [], ""
    for word in re.findall(r" +|[^ ]+", row):
        while len(held) + len(word) > columns:
            if held.strip():
                out.append(held.rstrip())
                held, word = "", word.lstrip()
            else:
                out.append(word[:columns])
                held, word = "", word[columns:]
        held += word
    return [*out, held.rstrip()] if held or not out else out


def wrap_runs(runs: list[Span], columns: int) -> list[list[Span]]:
    """The same for styled runs: the wrapped text's places cut the runs."""
    text = "".join(s.text for s in runs)
    out, at = [], 0
    for row in wrap(text, columns):
        at = text.index(row, at) if row else at
        out.append(blocks.sliced(runs, at, at + len(row)))
        at += len(row)
    return out


def entry_pages(pages: list[Page]) -> dict[int, int]:
    """The page on which each block begins."""
    out: dict[int, int] = {}
    for page in pages:
        for line in page.lines:
            out.setdefault(line.block, page.number)
    return out


# PDF

FACES = ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique")
ARMS = {"UP": (0, 1), "DOWN": (0, -1), "LEFT": (-1, 0), "RIGHT": (1, 0)}


def escaped(text: str) -> bytes:
    return re.sub(rb"([\\()])", rb"\\\1", text.encode("cp1252", "replace"))


@cache
def drawing(c: str) -> str | None:
    """Path operators of a box, block or shade character in a cell of one by one, by its name; null for others."""
    if not "─" <= c <= "▟":
        return None
    name = unicodedata.name(c, "")
    if name.startswith("BOX DRAWINGS"):
        words = set(name.replace("HORIZONTAL", "LEFT RIGHT").replace("VERTICAL", "UP DOWN").split())
        twice = (-0.08, 0.08) if "DOUBLE" in words else (0.0,)
        out = []
        for arm, (dx, dy) in ARMS.items():
            if arm in words:
                out += [f"{0.5 + d * abs(dy):g} {0.5 + d * abs(dx):g} m {0.5 + dx / 2 + d * abs(dy):g} {0.5 + dy / 2 + d * abs(dx):g} l" for d in twice]
        return " ".join(out) + " S" if out else None
    shade = {"LIGHT SHADE": 0.75, "MEDIUM SHADE": 0.5, "DARK SHADE": 0.25}.get(name, 0.0)
    x, y, w, h = {"UPPER HALF BLOCK": (0, 0.5, 1, 0.5), "LOWER HALF BLOCK": (0, 0, 1, 0.5), "LEFT HALF BLOCK": (0, 0, 0.5, 1), "RIGHT HALF BLOCK": (0.5, 0, 0.5, 1)}.get(name, (0, 0, 1, 1))
    return f"{shade:g} g {x:g} {y:g} {w:g} {h:g} re f 0 g"


def drawn(runs: list[Span], x: float, y: float, size: float, lead: float, roll: float) -> Iterator[bytes]:
    """Text, underlines and strokes of a line whose baseline begins at a point."""
    pitch = size * 0.6
    at = 0
    for s in runs:
        face = 1 + ("b" in s.styles) + 2 * ("i" in s.styles)
        rise = roll if "sup" in s.styles else -roll if "sub" in s.styles else 0.0
        for part in re.findall(r"[─-▟]+|[^─-▟]+", s.text):
            left = x + at * pitch
            if "─" <= part[0] <= "▟":
                for k, c in enumerate(part):
                    yield b"q %.2f 0 0 %.2f %.2f %.2f cm 0.06 w %s Q\n" % (pitch, lead, left + k * pitch, y - lead * 0.25, (drawing(c) or "n").encode())
            elif part.strip():
                yield b"BT /F%d %.2f Tf %.2f Ts 1 0 0 1 %.2f %.2f Tm (%s) Tj ET\n" % (face, size, rise, left, y, escaped(part))
            for tag, offset in (("u", -0.12), ("strike", 0.25)):
                if tag in s.styles and part.strip():
                    yield b"%.2f w %.2f %.2f m %.2f %.2f l S\n" % (size / 20, left, y + offset * size, left + len(part) * pitch, y + offset * size)
            at += len(part)


def pdf_bytes(pages: list[Page], body: Body) -> bytes:
    """A page's size, margins, lead and offset come from the document's commands, or from the defaults."""
    height_in, width_in = sheet(body)
    if body.settings.get("orientation") == "landscape":
        height_in, width_in = width_in, height_in
    height, width = height_in * 72, width_in * 72
    size = max(1.0, float(round(body.value("cw"))))
    lead = body.value("lh") * 1.5
    left = max(0.0, min(body.value("po") * POINTS_A_COLUMN, width - size * 0.6))
    roll = body.settings.get("roll", 3.0) * 1.5
    numbered = body.settings.get("auto_numbers", True)
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f.encode() for f in FACES]
    fonts = b" ".join(b"/F%d %d 0 R" % (k + 1, k + 3) for k in range(len(FACES)))
    kids = []
    for page in pages:
        out: list[bytes] = []
        top = height - (page.mt + (0 if "mt" in body.page else body.value("hm"))) * POINTS_A_LINE
        for side, base in ((page.heads, height - (page.mt - body.value("hm")) * POINTS_A_LINE), (page.feet, (page.mb - body.value("fm")) * POINTS_A_LINE)):
            for n, text in sorted(side.items()):
                runs = [Span(t.replace("#", str(page.number)), styles) for t, styles in blocks.head_runs(text)]
                out += drawn(runs, left, base - (n - 1) * POINTS_A_LINE, size, lead, roll)
        if numbered and not page.feet and page.lines:
            out += drawn([Span(str(page.number))], left + (body.value("pc") - 1) * size * 0.6, (page.mb - body.value("fm")) * POINTS_A_LINE, size, lead, roll)
        y = top - lead
        for k, line in enumerate(page.lines):
            if k and not page.lines[k - 1].over:
                y -= line.cost * lead
            out += drawn(line.runs, left, y, size, lead, roll)
        y = page.mb * POINTS_A_LINE + lead * len(page.foot)
        for k, row in enumerate(page.foot):
            out += drawn([Span(row)], left, y - k * lead, size, lead, roll)
        stream = b"".join(out)
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Resources << /Font << %s >> >> /Contents %d 0 R >>" % (round(width, 2), round(height, 2), fonts, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    made, offsets = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        offsets.append(len(made))
        made += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    start = len(made)
    made += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(made + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def sheet(body: Body) -> tuple[float, float]:
    """Height and width in inches: the nearest named size, if it is near enough."""
    from .dots import SIZES, SNAP

    height = body.value("pl") / 6 or 11.0
    near = min(SIZES, key=lambda s: abs(s[1] - height))
    return (near[1], near[2]) if abs(near[1] - height) <= SNAP else (height, 8.5)
