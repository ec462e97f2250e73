"""The byte reader and the output formats on built fixtures."""

import json
import random

import pytest

from palimpsest.operators import blocks, emit, printed, wordfile
from palimpsest.sources.files import parse_settings


def block(command: int, content: bytes) -> bytes:
    n = (len(content) + 4).to_bytes(2, "little")
    return b"\x1d" + n + bytes([command]) + content + n + b"\x1d"


def note(command: int, text: bytes, number: int = 0, inner: bytes = b"") -> bytes:
    return block(command, (1).to_bytes(2, "little") + number.to_bytes(2, "little") + b"\x30" + inner + text)


HEAD = block(0, b"\x55LASER" + bytes(10))


def test_wrap_and_paragraph_breaks():
    d = wordfile.parse(HEAD + b"one two\x8d\nthree\r\n\r\nfour\r\nfive\r\n")
    assert [x.sep for x in d.lines] == ["wrap", "para", "blank-hard", "line", "eof"]
    assert emit.text(d) == "one two three\n\nfour\nfive\n"


def test_flagged_word_ends():
    flag = lambda s: b" ".join(w[:-1] + bytes([w[-1] | 0x80]) for w in s.split(b" "))
    data = b"\x8d\n".join(flag(b"the quick brown fox jumps over the lazy dog and goes on") for _ in range(5)) + b"\r\n"
    assert wordfile.classify(data) == "ws4"
    assert wordfile.parse(data).lines[0].text == "the quick brown fox jumps over the lazy dog and goes on"


def test_notes_of_four_kinds_and_labels():
    tagged = note(5, b"tagged", 0, block(5, b"\0\0\0\0\0AC1"))
    d = wordfile.parse(HEAD + b"a" + note(3, b"foot") + b"b" + note(4, b"end") + tagged + note(6, b"secret") + b"\r\n")
    assert [(n.kind, n.text, n.number, n.tag) for n in d.notes] == [("footnote", "foot", 0, None), ("endnote", "end", 0, None), ("annotation", "tagged", None, "AC1"), ("comment", "secret", None, None)]
    assert [s for _, s in emit.labels(d.notes)] == ["1", "i", "AC1", "c1"]
    assert "secret" not in emit.text(d)
    assert "secret" in emit.text(d, notes=emit.NOTE_KINDS)
    assert "[^1]" in emit.markdown(d)
    assert 'role="doc-noteref"' in emit.html(d)
    assert "\\footnote\\ftnalt" in emit.rtf(d)


def test_blocks():
    tab = block(9, (720).to_bytes(2, "little") + bytes(2) + b" \x00")
    font = block(2, b"".join(x.to_bytes(2, "little") for x in (150, 240, 7, 0, 0, 0)))
    number = block(0x0D, bytes([1, 0, 2, 0, 0, 2, 0]) + bytes(40))
    d = wordfile.parse(HEAD + tab + b"x" + font + b"y" + number + block(0x10, b"C:\\ART\\CAT.PIX") + block(0x16, b"") + block(0x77, b"??") + b"\r\n")
    assert d.lines[0].text == "    xy1.3[image: CAT.PIX]<TRUNCATED>"
    assert d.lines[0].tab_indent
    assert d.fonts == [{"width_hmi": 150, "height_vmi": 240, "typestyle": 7}]
    assert [u[0] for u in d.unknown] == [0x77]
    assert (d.release, d.driver) == ("5.5", "ULASER")


def test_styles_and_wrapped_characters():
    d = wordfile.parse(HEAD + b"a\x02b\x02 \x19c\x19 \x1b\x01\x1c\x1b\x0a\x1c\r\n")
    assert [(s.text, s.styles) for s in d.lines[0].spans] == [("a", ()), ("b", ("b",)), (" ", ()), ("c", ("i",)), (" ", ()), ("☺", ()), ("◙", ())]
    assert emit.markdown(d).startswith("a**b** *c*")


def test_print_stream_is_verbatim():
    d = wordfile.parse(b"Title\r\n   \x1ebold\x1f text here and there\r\n\x0cPage two is here\r\n")
    assert d.variant == "printstream"
    assert [x.text for x in d.lines] == ["Title", "   bold text here and there", "", "Page two is here"]
    assert emit.effective_mode(d, "modern") == "printed"
    assert emit.pdf(d).count(b"/Type /Page ") == 2


@pytest.mark.parametrize("variant", [None, "ws4", "ws5+", "printstream"])
def test_random_bytes_round_trip_or_raise_the_typed_error(variant):
    r = random.Random(5)
    for _ in range(300):
        data = bytes(r.choice([r.randrange(256), 0x1D, 0x1B, 0x0D, 0x0A, 0x8D, 0x8A, 0x20, 0x41, 0x0C]) for _ in range(r.randrange(200)))
        try:
            d = wordfile.parse(data, variant)
        except wordfile.ParseError:
            continue
        assert b"".join(x.raw + x.brk for x in d.lines) + d.tail == data


def test_native_round_trip_and_edit():
    data = HEAD + b"Hello \x02bold\x02 world\r\nsecond\r\n\x1a\x1a"
    d = wordfile.parse(data)
    assert emit.native(d) == data
    d.lines[1].spans[0].text = "changed"
    assert emit.native(d).endswith(b"changed\r\n\x1a\x1a")


def test_rendering_twice_is_equal():
    data = HEAD + b"a\x02\x19\x13b" + note(3, b"n") + b"\r\n.pl 66\r\nc\r\n"
    for name in ("text", "markdown", "html", "rtf", "layout", "pdf", "diagnose"):
        assert emit.convert_bytes(data, name) == emit.convert_bytes(data, name)
    assert json.loads(emit.convert_bytes(data, "diagnose"))["dot_commands"] == [".pl 66"]


def test_errors_are_rows(spark):
    files = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(bytes(range(1, 26)) * 9)), (3, bytearray(b"plain text line\r\nanother line\r\n")), (4, None)], "doc_id long, content binary")
    rows = {r["doc_id"]: r for r in emit.convert(files, "text").collect()}
    assert rows[1]["error"]["kind"] == "empty"
    assert rows[2]["error"]["kind"] == "binary"
    assert rows[3]["output"] == "plain text line\nanother line\n"
    assert rows[4]["error"]["kind"] == "empty"
    read = wordfile.read_documents(files).where("doc_id = 3").collect()[0]
    assert read["variant"] == "printstream" and len(read["lines"]) == 2


def test_settings_dump():
    assert parse_settings(b'INIEDT=01,0A,"ab"\r\n=02\r\nX=1\r\nX=02\r\n\x1aY=3') == {"INIEDT": b"\x01\nab\x02", "X": b"\x02"}


def test_wrap_at_columns():
    assert emit.wrap("aaa bbb ccc", 7) == ["aaa bbb", "ccc"]
    assert emit.wrap("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert emit.wrap("", 4) == [""]


def test_unknown_format():
    with pytest.raises(ValueError, match="no format"):
        emit.get_emitter("nope")


def library(base: int) -> bytes:
    """A style library with one index block of two styles, a heading and a centred quotation."""
    def entry(name: bytes, at: int) -> bytes:
        return name.ljust(24) + b"\x02" + bytes(4) + at.to_bytes(4, "little")

    record = lambda just, bits: bytes(86) + just.to_bytes(1, "little", signed=True) + bytes(4) + bits.to_bytes(2, "little") + bytes(9)
    head = b"\x1aU" + bytes(3) + (2).to_bytes(2, "little") + (102).to_bytes(2, "little") + (13).to_bytes(4, "little")
    index = bytes([2]) + bytes(4) + entry(b"Title", 13 + 5 + 66) + entry(b"Block Quote", 13 + 5 + 66 + 102)
    return head + index + record(0, 2) + record(-2, 0)


def test_styles_by_library():
    select = lambda slot: block(0x11, (0x0200 | slot).to_bytes(2, "little") + bytes(6))
    text = select(0) + b"Big\r\n\r\n" + select(1) + b"said\r\nagain\r\n"
    size = len(block(0, bytes(20))) + len(text)
    head = block(0, b"\x55LASER" + bytes(6) + (size).to_bytes(4, "little") + bytes(4))
    assert len(head) == len(block(0, bytes(20)))
    d = wordfile.parse(head + text + library(size))
    assert [(s["name"], s["attrs"], s["align"]) for s in d.styles] == [("Title", ["b"], "left"), ("Block Quote", [], "center")]
    assert emit.markdown(d).startswith("# **Big**\n\n> said\n> again")
    out = emit.html(d)
    assert '<h1 class="ws-0-title">Big</h1>' in out and '<blockquote><p class="ws-1-block-quote" style="text-align:center;line-height:1.2">said' in out
    assert ".ws-0-title { text-align:left; font-weight:bold }" in out
    assert "{\\s1\\b Title;}" in emit.rtf(d) and "\\qc " in emit.rtf(d)


def test_alignment_by_dot_commands_and_flagged_controls():
    d = wordfile.parse(HEAD + b"a\r\n.oc on\r\nmid\r\n.oc off\r\nx\x82y\x82z\r\n")
    assert [b.look.align for b in blocks.body_of(d).blocks] == ["left", "center", "left"]
    assert '<p style="text-align:center;line-height:1.2">mid</p>' in emit.html(d)
    assert [(s.text, s.styles) for s in d.lines[-1].spans] == [("x", ()), ("y", ("b",)), ("z", ())]


def lines_to_bytes(*lines: str) -> bytes:
    return HEAD + "\r\n".join(lines).encode("cp437") + b"\r\n"


@pytest.mark.parametrize("spelling", [".pl66", ".PL 66", ".LM8", ".h1 Running title", ".tc2 Entry", ".f1", ".p# 1", ".l# 5", ".cw12", ".mt 1\"", ".ixword", ".av x"])
@pytest.mark.parametrize("variant", ["ws4", "ws5+"])
def test_no_command_is_text_in_any_format(spelling, variant):
    d = wordfile.parse(lines_to_bytes("One line here.", spelling, "Another line."), variant)
    for to in ("text", "markdown", "html", "rtf"):
        said = emit.get_emitter(to)(d)
        assert spelling not in said and "One line here" in said and "Another line" in said


def test_breaks_reach_every_format():
    d = wordfile.parse(lines_to_bytes("One", "", ".pa", "Two", "", ".cp 60", "Three"), "ws5+")
    assert emit.pdf(d).count(b"/Type /Page ") == 3
    assert "\n---\n" in emit.markdown(d)
    assert '<hr class="pb">' in emit.html(d)
    assert "\\page " in emit.rtf(d)
    assert "-" * 20 in emit.text(d) and "\f" in emit.text(d, "printed")
    kinds = [x["kind"] for x in json.loads(emit.layout(d))["modern"]["items"]]
    assert "break" in kinds and "cond" in kinds


def test_geometry_heads_and_numbers_of_printed_pages():
    text = [".mt 6", ".mb 6", ".he Chapter #", ".pn 7", *(f"line {k}" for k in range(120))]
    d = wordfile.parse(lines_to_bytes(*text), "ws5+")
    b = blocks.body_of(d)
    pages = printed.pages_of(b, {})
    assert [len(p.lines) for p in pages] == [54, 54, 12]
    assert [p.number for p in pages] == [7, 8, 9]
    assert all(p.heads == {1: "Chapter #"} for p in pages)
    made = emit.pdf(d)
    assert b"(Chapter 7)" in made and b"(Chapter 9)" in made
    assert "{\\header " in emit.rtf(d) and "\\margt1440" in emit.rtf(d)


def test_styles_and_colours_in_pdf_and_rtf():
    colour = block(1, bytes([4, 0]))
    d = wordfile.parse(HEAD + b"plain \x02bold\x02 \x19it\x19 \x13under\x13 " + colour + b"red\r\n", "ws5+")
    made = emit.pdf(d)
    assert b"/Courier-Bold" in made and b"/F2 " in made and b"/F3 " in made and b" l S" in made
    said = emit.rtf(d)
    assert "{\\colortbl;" in said and "\\red170\\green0\\blue0;" in said and "\\cf5 red" in said


def test_notes_at_the_foot_and_their_continuation():
    long = " ".join(["word"] * 700)
    d = wordfile.parse(HEAD + b"\r\n".join([b"first" + note(3, long.encode())] + [b"line"] * 60) + b"\r\n", "ws5+")
    pages = printed.pages_of(blocks.body_of(d), {0: "1"})
    assert pages[0].foot[0] == "-" * 20 and pages[0].foot[-1] == "...Continued..."
    assert pages[1].foot[0] == "-" * 20
    words = sum(x.split().count("word") for p in pages for x in p.foot)
    assert words == 700 and sum(len(p.lines) for p in pages) == 61


def test_state_of_commands():
    b = blocks.body_of(wordfile.parse(lines_to_bytes(".lm 8", ".rm 6.5\"", ".co2, 0.3\"", ".tb 5 10,15", "a", "", ".lm 0.7\"", ".pr or=l", ".sr 3/48", ".f# 4", ".l# 0", ".op", "b"), "ws5+"))
    one, two = (x.look for x in b.blocks)
    assert (one.left, one.right, one.columns, one.gutter, one.tabs) == (7.0, 65.0, 2, 3.0, (5.0, 10.0, 15.0))
    assert two.left == 7.0
    assert b.settings == {"orientation": "landscape", "roll": 3.0, "footnote_start": 4, "line_numbers": None, "auto_numbers": False}


def test_comment_lines_are_notes_in_order():
    d = wordfile.parse(HEAD + b"a" + note(3, b"foot") + b"\r\n..remark\r\nb" + note(3, b"second") + b"\r\n.ig other\r\nc\r\n", "ws5+")
    b = blocks.body_of(d)
    assert [(n.kind, n.text, n.origin) for n in b.notes] == [("footnote", "foot", "block"), ("comment", "remark", ".."), ("footnote", "second", "block"), ("comment", "other", ".ig")]
    assert [s.ref for x in b.blocks for y in x.lines for s in y.spans if s.ref is not None] == [0, 1, 2, 3]
    assert "remark" not in emit.text(d) and "remark" in emit.text(d, notes=emit.NOTE_KINDS)


def test_verse_dialogue_and_prose():
    stanza = ["     The leaves are turning,", "     the river runs slow,", "     a boat is returning", "     from far, long ago"]
    talk = ['     "Who is there?"', '     "It is only me."', '     "Come in then."', '     "Thank you."']
    d = wordfile.parse(lines_to_bytes(*stanza, "", *talk), "ws5+")
    assert emit.text(d).count("\n\n") == 4  # one stanza, four paragraphs
    wide = "word " * 12
    d = wordfile.parse(lines_to_bytes("     " + wide.strip(), wide.strip(), "     " + wide.strip()), "ws5+")
    assert len(emit.text(d).strip().split("\n\n")) == 2


def test_lines_placed_by_hand_stay():
    rows = ["A     B     C", "1     2     3", "4     5     6"]
    d = wordfile.parse(lines_to_bytes(".aw off", *rows), "ws5+")
    assert emit.text(d).splitlines()[:3] == rows


def test_scenes_keep_their_lines():
    scene = ["INT. KITCHEN - DAY", "The kettle boils over and everybody looks at it.", "", "          ANN", "     It is done."]
    d = wordfile.parse(lines_to_bytes(*scene), "ws5+")
    assert blocks.body_of(d).scenes == {0, 1}
    assert "DAY\nThe kettle" in emit.text(d)
    for text in ("INT KITCHEN", "EST. 1900 house", "int. kitchen", "INTERIOR. x"):
        assert not blocks.SLUGLINE.match(text)
    for text in ("12 INT. HALL", "  EXT. FIELD", "&scene& INT./EXT. CAR", "I/E. CAR", "3  &n& EXT. SEA"):
        assert blocks.SLUGLINE.match(text)


def test_nested_lists_and_definitions():
    rows = ["* one thing", "* other thing", "   - inner thing", "   - inner other", "* last thing", "", "name:   what it is", "", "plain words after the list that go on."]
    d = wordfile.parse(lines_to_bytes(*rows), "ws5+")
    said = emit.html(d)
    assert "<ul><li>one thing</li><li>other thing<ul><li>inner thing</li><li>inner other</li></ul></li><li>last thing" in said
    assert "<dl><dt>name:</dt><dd>what it is</dd></dl>" in said
    for tag in ("ul", "li", "dl", "dd", "p"):
        assert said.count(f"<{tag}>") + said.count(f"<{tag} ") == said.count(f"</{tag}>")


def test_contents_and_index():
    d = wordfile.parse(lines_to_bytes(".tc1 First #", "text", "", ".pa", ".tc2 Second", ".ix term", "more"), "ws5+")
    assert "TABLE OF CONTENTS\n\nFirst\n  Second\n\nINDEX\n\nterm" in emit.text(d, toc=True)
    said = emit.rtf(d, "printed", toc=True)
    assert "First 1" in said and "Second 2" in said and "term 2" in said


def test_one_parse_for_many_formats(spark):
    files = spark.createDataFrame([(1, bytearray(lines_to_bytes("Some text here.")))], "doc_id long, content binary")
    row = emit.convert_many(files, ("text", "pdf", "native")).collect()[0]
    assert row["text"] == "Some text here.\n" and bytes(row["pdf"]).startswith(b"%PDF") and bytes(row["native"]) == lines_to_bytes("Some text here.")
    with pytest.raises(ValueError, match="mode"):
        emit.convert(files, "text", mode="wrong")


def test_both_detectors_agree(spark):
    from palimpsest.operators import detect

    r = random.Random(7)
    pools = [list(range(256)), [0x8D, 0x0A, 0x41, 0x20, 0xE1], [0x0D, 0x0A, 0x41, 0x20, 0x1A], [0x1D, 0x41, 0x20, 0x1B, 0x1C]]
    rows = [(k, bytearray(r.choice(pools[k % 4]) for _ in range(r.randrange(120)))) for k in range(400)] + [(1000, bytearray(HEAD + b"text here"))]
    found = detect.detect(spark.createDataFrame(rows, "doc_id long, content binary")).collect()
    assert {x["doc_id"]: x["variant"] for x in found} == {k: wordfile.classify(bytes(b)) for k, b in rows}


def test_command_line(spark, tmp_path, capsys):
    from palimpsest.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ONE.WS").write_bytes(lines_to_bytes(".he Top", "Some text here."))
    (tmp_path / "in" / "BAD.WS").write_bytes(bytes(range(1, 26)) * 9)
    out = tmp_path / "out"
    assert main(["--to", "text", "pdf", "--out", f"file://{out}", "--page-settings", "mt=2in,size=a4", str(tmp_path / "in" / "ONE.WS")]) == 0
    assert (out / "ONE.txt").read_text() == "Some text here.\n"
    assert b"/MediaBox [0 0 595.3 841.9]" in (out / "ONE.pdf").read_bytes()
    assert main(["--to", "text", "--out", f"file://{out}", str(tmp_path / "in" / "BAD.WS"), str(tmp_path / "in" / "NONE.WS")]) == 1
    said = capsys.readouterr().err
    assert "BAD.WS: binary" in said and "NONE.WS: missing" in said


def test_machine_settings_count_where_the_document_is_silent():
    d = wordfile.parse(lines_to_bytes(".mt 6", *("x" for _ in range(100))), "ws5+")
    facts = json.loads(emit.diagnose(d, page={"mt": 2.0, "mb": 4.0}))["page"]
    assert facts["mt"] == {"value": 6.0, "source": "file"} and facts["mb"] == {"value": 4.0, "source": "machine-default"}
    assert [len(p.lines) for p in printed.pages_of(blocks.body_of(d, {"mb": 4.0}), {})] == [56, 44]
