"""PDF texts: page order, object streams, character maps, filters, forms, and files that are not sound."""

import base64
import zlib

import pytest
from pathloom.sources import pdf
from pathloom.sources.documents import ExtractError, pdf_text
from pathloom.sources.pdf import unpacked_lzw, unpacked_runs


def stream(body, head=b""):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(body), body)


def file_of(objects):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % item for item in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def page(contents, more=b""):
    return b"<< /Type /Page /Parent 2 0 R /Contents %s %s >>" % (contents, more)


def lzw(data):
    """A plain coder: codes of one byte each, cleared before the table can widen codes."""
    bits = ""
    for k, c in enumerate(data):
        bits += ("100000000" if k % 200 == 0 else "") + format(c, "09b")
    bits += "100000001"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def lzw_wide(data):
    """The usual coder, with growing codes."""
    table, bits, width, last = {bytes([k]): k for k in range(256)}, format(256, "09b"), 9, b""
    size = 258
    for c in data:
        if last + bytes([c]) in table:
            last += bytes([c])
            continue
        bits += format(table[last], f"0{width}b")
        table[last + bytes([c])] = size
        size += 1
        width = 9 + sum(size > limit for limit in (511, 1023, 2047))
        last = bytes([c])
    bits += format(table[last], f"0{width}b") + format(257, f"0{9 + sum(size + 1 > limit for limit in (511, 1023, 2047))}b")
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_pages_come_in_the_order_of_their_tree():
    words = [b"BT (leaf %d) Tj ET" % k for k in range(4)]
    objects = {9: stream(words[2]), 8: stream(words[0]), 7: stream(words[1]), 6: stream(words[3]), 1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R 12 0 R] >>", 3: b"<< /Kids [10 0 R 11 0 R 2 0 R] >>"}
    objects |= {10: page(b"8 0 R"), 11: page(b"[7 0 R 9 0 R]"), 12: page(b"6 0 R")}
    assert pdf_text(file_of(objects)) == "leaf 0\nleaf 1\nleaf 2\nleaf 3"


def test_later_objects_replace_earlier_ones():
    data = file_of({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: page(b"4 0 R"), 4: stream(b"BT (draft) Tj ET")})
    assert pdf_text(data + b"\n4 0 obj\n" + stream(b"BT (final) Tj ET") + b"\nendobj\n") == "final"


def test_objects_in_streams_and_lengths_elsewhere():
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [3 0 R] >>"), (3, page(b"4 0 R"))]
    body, heads = b"", b""
    for number, value in inner:
        heads += b"%d %d " % (number, len(body))
        body += value + b" "
    packed = zlib.compress(heads + body)
    text = b"BT (with endstream inside) Tj ET"
    data = file_of({20: stream(packed, b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(heads)), 4: b"<< /Length 5 0 R >>\nstream\n" + text + b"\nendstream", 5: b"%d" % len(text)})
    assert pdf_text(data) == "with endstream inside"


CMAP = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <ffff> endcodespacerange
3 beginbfchar <0001> <0417> <0002> <D83DDE00> <0003> <00660066> endbfchar
2 beginbfrange <0010> <0014> <0061> <0020> <0021> [<0031> <0032>] endbfrange end"""


def test_character_maps():
    shown = b"BT /F1 9 Tf <0001000200030010> Tj <001400200021> Tj <7777> Tj /F2 9 Tf (caf\\351) Tj ET"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] /Resources << /Font 5 0 R >> >>", 3: page(b"4 0 R"), 4: stream(shown)}
    objects |= {5: b"<< /F1 6 0 R /F2 << /Type /Font >> >>", 6: b"<< /Type /Font /ToUnicode 7 0 R >>", 7: stream(zlib.compress(CMAP), b"/Filter /FlateDecode")}
    assert pdf_text(file_of(objects)) == "З😀ffae12café"


TEXT = b"BT (all filters say the same) Tj ET"


@pytest.mark.parametrize(
    ("name", "body"),
    [
        (b"/FlateDecode", zlib.compress(TEXT)), (b"/ASCII85Decode", base64.a85encode(TEXT) + b"~>"), (b"/ASCIIHexDecode", TEXT.hex().encode() + b" >"), (b"/LZWDecode", lzw(TEXT)), (b"/LZWDecode", lzw_wide(TEXT)),
        (b"/RunLengthDecode", bytes([len(TEXT) - 1]) + TEXT + bytes([128])), (b"[/A85 /Fl]", base64.a85encode(zlib.compress(TEXT), adobe=True)),
    ],
)
def test_filters(name, body):
    data = file_of({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: page(b"4 0 R"), 4: stream(body, b"/Filter " + name)})
    assert pdf_text(data) == "all filters say the same"


def test_packed_data_round_trips():
    data = bytes(range(256)) * 40 + b"abcabcabc" * 3000
    assert unpacked_lzw(lzw(data)) == data and unpacked_lzw(lzw_wide(data[:3000])) == data[:3000]
    assert unpacked_runs(bytes([2]) + b"xyz" + bytes([250]) + b"q" + bytes([128]) + b"rest") == b"xyzqqqqqqq"


@pytest.mark.parametrize(("head", "body"), [(b"/Filter /JBIG2Decode", b"x"), (b"/Filter /FlateDecode", b"no zlib"), (b"/Filter /LZWDecode", b"\xff\xff"), (b"/Filter /FlateDecode /DecodeParms << /Predictor 12 >>", zlib.compress(TEXT))])
def test_what_cannot_be_read_is_an_error(head, body):
    with pytest.raises(ExtractError):
        pdf_text(file_of({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: page(b"4 0 R"), 4: stream(body, head)}))


def test_forms_images_and_spaces():
    shown = b"BT (over) Tj ET q BI /W 1 ID (junk) Tj \x00\xff EI Q /Fm Do BT [(wide) -300 (gap) -20 (s)] TJ T* (next) ' ET"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: page(b"4 0 R", b"/Resources << /XObject << /Fm 5 0 R /Im 6 0 R >> >>"), 4: stream(shown)}
    objects |= {5: stream(b"BT (in a form) Tj ET /Fm Do", b"/Subtype /Form"), 6: stream(b"BT (not text) Tj ET", b"/Subtype /Image /Filter /DCTDecode")}
    text = pdf_text(file_of(objects)).split("\n")
    assert text[0] == "over" and "in a form" in text and text[-3:] == ["wide gaps", "", "next"] or text[-2:] == ["wide gaps", "next"]
    assert not any("junk" in line or "not text" in line for line in text)


def test_odd_files_end():
    for data in (b"%PDF-1.4\n1 0 obj 1 0 R endobj", b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R /Kids [1 0 R] >>", b"%PDF-1.4\n1 0 obj (open", b"%PDF-1.4 >> ] } 1 0 obj << /A << /B"):
        assert pdf_text(data) == ""
    with pytest.raises(ExtractError):
        pdf_text(b"%PDF-1.4\n1 0 obj " + b"[" * 500)
    assert pdf_text(b"%PDF-1.4\n" + b"9 0 obj << >> endobj\n" * 20_000) == ""
    assert [v for v, _ in pdf.values(b"(a\\(b(c)) /N#61me <4 1> 1.5 -2 true % no\n[1 2 R]")] == [b"a(b(c)", "/Name", b"A", 1.5, -2, "true", [pdf.Ref(1)]]


def test_lists_of_codes_read_alike_at_once_and_one_by_one():
    codes = lambda body: (font := pdf.Font.__new__(pdf.Font), setattr(font, "codes", {}), font._read(body))[0].codes
    plain = b"2 beginbfchar\n<01> <0041>\n<02> <D83DDE00>\nendbfchar 1 beginbfchar <3> <4> endbfchar"
    spaced = plain.replace(b"<0041>", b"<00 41>").replace(b"<3>", b"<3 >")
    assert codes(plain) == codes(spaced) == {b"\x01": "A", b"\x02": "\U0001f600", b"\x30": "@"}
