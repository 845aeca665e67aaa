"""PDF reader and layout over files that are made here, by hand-written objects."""

import zlib

import pytest

from quillmark.operators.ingest import extraction
from quillmark.plans.analyze import analyze
from quillmark.sources import documents, layout, pdf


def stream(told: str, data: bytes, packed=True) -> bytes:
    data = zlib.compress(data) if packed else data
    return f"<< {told} {'/Filter /FlateDecode' if packed else ''} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"


def classic(objects: dict[int, bytes], break_places=False, **trailer) -> bytes:
    """A file with a cross-reference table."""
    out, places = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in objects.items():
        places[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    at = len(out)
    last = max(objects) + 1
    out += f"xref\n0 {last}\n".encode() + b"0000000000 65535 f \n"
    for n in range(1, last):
        out += b"%010d %05d %s \n" % (places.get(n, 0) + 7 * break_places, 0, b"n" if n in places else b"f")
    return out + f"trailer\n<< /Size {last} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF".encode()


def modern(objects: dict[int, bytes]) -> bytes:
    """A file with an object stream and a cross-reference stream with a PNG predictor; streams can't be packed."""
    out, places = b"%PDF-1.5\n", {}
    inner = {n: b for n, b in objects.items() if b"stream" not in b}
    for n in objects.keys() - inner.keys():
        places[n] = (1, len(out), 0)
        out += f"{n} 0 obj\n".encode() + objects[n] + b"\nendobj\n"
    holder = max(objects) + 1
    heads, body = [], b""
    for i, (n, b) in enumerate(inner.items()):
        heads.append(f"{n} {len(body)}")
        body += b + b"\n"
        places[n] = (2, holder, i)
    head = (" ".join(heads) + " ").encode()
    places[holder] = (1, len(out), 0)
    out += f"{holder} 0 obj\n".encode() + stream(f"/Type /ObjStm /N {len(inner)} /First {len(head)}", head + body) + b"\nendobj\n"
    at = len(out)
    places[holder + 1] = (1, at, 0)
    rows, above = b"", bytes(6)
    for n in range(holder + 2):
        kind, a, b = places.get(n, (0, 0, 0))
        row = bytes([kind]) + a.to_bytes(4, "big") + bytes([b])
        rows += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    told = f"/Type /XRef /Size {holder + 2} /W [1 4 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 6 >>"
    return out + f"{holder + 1} 0 obj\n".encode() + stream(told, rows) + f"\nendobj\nstartxref\n{at}\n%%EOF".encode()


def lines(texts, x, y, size=10, lead=12) -> str:
    """Operators for lines of text, in the encoding of the pages' font."""
    escaped = [t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for t in texts]
    return f"BT /F1 {size} Tf {lead} TL {x} {y} Td " + " T* ".join(f"({t}) Tj" for t in escaped) + " ET\n"


def objects(pages: list[str], packed=True) -> dict[int, bytes]:
    """A catalogue, a tree of two levels, a font with widths, and the pages' contents."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages)))
    widths = " ".join(["500"] * 224)
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 9 /Resources << /Font << /F1 4 0 R >> >> >>", 3: f"<< /Type /Pages /Parent 2 0 R /Kids [{kids}] >>".encode(), 4: f"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [{widths}] >>".encode()}
    for i, text in enumerate(pages):
        out[10 + 2 * i] = f"<< /Type /Page /Parent 3 0 R /Contents {11 + 2 * i} 0 R >>".encode()
        out[11 + 2 * i] = stream("", text.encode("cp1252"), packed)
    return out


LEFT = [f"Left line {i} of the first column goes on and" for i in range(8)] + ["ends here."]
RIGHT = [f"Right line {i} of the second column goes on and" for i in range(8)] + ["ends there."]


def paper() -> list[str]:
    """Three pages of two columns with a title, a running head, a page number and a list."""
    out = []
    for n in range(3):
        page = lines([f"Journal of Examples {n + 1}"], 72, 770, 8) + lines([str(n + 1)], 300, 30, 8)
        if n == 0:
            page += lines(["A Title over both columns"], 150, 730, 18)
        out.append(page + lines(RIGHT, 330, 680) + lines(LEFT, 60, 680) + lines(["1. first point of the list", "goes on here"], 60, 400))
    return out


@pytest.mark.parametrize("make", [classic, modern, lambda o: classic(o, break_places=True)])
@pytest.mark.parametrize("packed", [True, False])
def test_both_kinds_of_files_and_broken_references(make, packed):
    file = pdf.File(make(objects(paper(), packed)))
    pages = file.pages()
    assert len(pages) == 3
    found = layout.blocks([pdf.runs(file, p) for p in pages])
    first = [(b.kind, b.text) for b in found if b.page == 1]
    assert first == [
        ("Header", "Journal of Examples 1"),
        ("Title", "A Title over both columns"),
        ("NarrativeText", "\n".join(LEFT)),
        ("NarrativeText", "\n".join(RIGHT)),
        ("ListItem", "1. first point of the list\ngoes on here"),
        ("Footer", "1"),
    ]


def test_text_operators_and_strings():
    text = b"BT /F1 10 Tf 72 700 Td (a \\(b\\) \\101\\\n!) Tj 0 -20 TD [(sp) -600 (lit) 20 (ted)] TJ T* <68 69> Tj 1 0 0 1 72 600 Tm (tm) Tj 5 2 (quoted) \" ET q 2 0 0 2 0 0 cm BT /F1 10 Tf 10 10 Td (big) Tj ET Q BI /W 1 ID \x00(x)Tj EI BT /F1 10 Tf 72 100 Td (after) Tj ET"
    made = objects(["x"])
    made[11] = stream("", text)
    file = pdf.File(classic(made))
    got = pdf.runs(file, file.pages()[0])
    assert [r.text for r in got] == ["a (b) A!", "sp", "lit", "ted", "hi", "tm", "quoted", "big", "after"]
    assert [round(r.y) for r in got] == [700, 680, 680, 680, 660, 600, 580, 20, 100]
    assert got[2].x0 - got[1].x1 == pytest.approx(6) and got[7].size == 20
    assert layout._joined(got[1:4]) == "sp litted"


def test_fonts_by_differences_maps_and_wide_codes():
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <00790079>] endbfrange endcmap"
    made = objects(["x"])
    made[4] = b"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /quoteright /uni03B1 /x] >> >>"
    made[2] = made[2].replace(b"/F1 4 0 R", b"/F1 4 0 R /F2 5 0 R")
    made[5] = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
    made[6] = b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [1 [700 800] 16 18 250] >>"
    made[7] = stream("", cmap)
    made[11] = stream("", b"BT /F1 10 Tf 10 50 Td (ABCDE\x80) Tj /F2 10 Tf 0 -20 Td <0001000200100011001200200021> Tj ET")
    file = pdf.File(modern(made))
    one, two = pdf.runs(file, file.pages()[0])
    assert one.text == "é’αxE€" and two.text == "A\U0001f600abcxyy"
    assert two.x1 - two.x0 == pytest.approx((700 + 800 + 3 * 250 + 2 * 600) / 100)


def test_forms_and_filters():
    made = objects(["q /Fm Do Q"])
    made[2] = made[2].replace(b"/Font <<", b"/XObject << /Fm 8 0 R >> /Font <<")
    import base64

    made[8] = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 0] /Filter [/ASCII85Decode /FlateDecode] /Length 9 0 R >>\nstream\n" + (body := base64.a85encode(zlib.compress(b"BT /F1 10 Tf 5 5 Td (form) Tj ET /Fm Do")) + b"~>") + b"\nendstream"
    made[9] = str(len(body)).encode()
    file = pdf.File(classic(made))
    got = pdf.runs(file, file.pages()[0])
    assert got[0].text == "form" and (got[0].x0, got[0].y) == (105, 5) and len(got) < pdf.DEEPEST


def test_predictors():
    rows = bytes(range(12))
    coded = b"\x01" + bytes([0, 1, 1, 1]) + b"\x03" + bytes([4, 3, 3, 3]) + b"\x04" + bytes([4, 1, 1, 1])
    assert pdf._unpredicted(coded, {"Predictor": 15, "Columns": 4}) == rows
    assert pdf._unpredicted(bytes([1, 1, 1, 5, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])


def test_files_become_rows_and_broken_ones_errors(spark, tmp_path):
    good = classic(objects(paper()))
    (tmp_path / "a.pdf").write_bytes(good)
    (tmp_path / "b.PDF").write_bytes(modern(objects(paper())))
    (tmp_path / "c.pdf").write_bytes(good[:200])
    (tmp_path / "d.pdf").write_bytes(b"no header at all")
    (tmp_path / "e.pdf").write_bytes(classic(objects([])))
    (tmp_path / "f.pdf").write_bytes(good.replace(b"/Root 1 0 R", b"/Encrypt 4 0 R /Root 1 0 R"))
    files = documents.uploads(spark, str(tmp_path))
    meta = {r["filename"]: r["page_count"] for r in documents.metadata(spark, str(tmp_path)).collect()}
    assert meta == {"a.pdf": 3, "b.PDF": 3, "c.pdf": 0, "d.pdf": 0, "e.pdf": 0, "f.pdf": 3}
    told = {r["doc_id"].rsplit("/", 1)[1]: r for r in documents.decoded(files).collect()}
    assert told["a.pdf"]["text"] == told["b.PDF"]["text"] and "Left line 3" in told["a.pdf"]["text"] and told["a.pdf"]["error"] is None
    assert all(told[n]["error"] and told[n]["text"] == "" for n in ("c.pdf", "d.pdf", "f.pdf"))
    got = {r["doc_id"].rsplit("/", 1)[1]: r for r in extraction(documents.decoded(files)).collect()}
    assert got["a.pdf"]["extraction_method"] == "elements" and got["a.pdf"]["parts"][0] == " ".join(LEFT)
    assert not any("Journal" in p for p in got["a.pdf"]["parts"])
    a = analyze(documents.decoded(files))
    report = {r["doc_id"].rsplit("/", 1)[1]: r["status"] for r in a["report"].collect()}
    assert report == {"a.pdf": "success", "b.PDF": "success", "c.pdf": "error", "d.pdf": "error", "e.pdf": "error", "f.pdf": "error"}
    codes = {(r["doc_id"].rsplit("/", 1)[1], r["code"]) for r in a["warnings"].collect()}
    assert ("c.pdf", "pdf_corrupt") in codes and ("a.pdf", "pdf_corrupt") not in codes
