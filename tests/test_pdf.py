"""Pages of PDF files that are written here byte by byte."""

import zlib

import pytest

from quillgraph.sources import pdf


def written(objects: dict[int, bytes], trailer: bytes = b"<< /Root 1 0 R /Info 9 0 R >>") -> bytes:
    body = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return body + b"trailer\n" + trailer + b"\n%%EOF"


def stream(data: bytes, packed: bool = True, more: bytes = b"") -> bytes:
    raw = zlib.compress(data) if packed else data
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(raw), b"/Filter /FlateDecode " * packed, more, raw)


CMAP = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<00C9> <0062>] endbfrange"
BOOK = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 20 0 R] /Count 4 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [10 0 R 11 0 R] >>",
    20: b"<< /Type /Pages /Parent 2 0 R /Kids [21 0 R 22 0 R 23 0 R] >>",
    21: b"<< /Type /Page /Contents 12 0 R >>",
    22: b"<< /Type /Page /Contents 13 0 R >>",
    23: b"<< /Type /Page /Contents 14 0 R >>",
    7: b"<< /Type /Font /Subtype /Type1 >>",
    8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 15 0 R >>",
    9: b"<< /Title (A \\(small\\) book) /Producer (hand) >>",
    10: stream(b"BT /F1 12 Tf (Adi ) Tj (Par\\166a) Tj 0 -14 Td (SECTION I) Tj ET"),
    11: stream(b"BT (12) Tj T* [(Wo) 20 (rds) -300 (apart) ] TJ (second line) ' ET", packed=False),
    12: stream(b"BT /F2 9 Tf <0010001100030012> Tj 0 -9 TD <00200021> Tj ET"),
    13: stream(b"BT (  7 ) Tj ET"),
    14: stream(b"% nothing (shown) Tj\nBT (last \\\npage caf\xe9) Tj ET"),
    15: stream(CMAP),
}


def test_pages_in_order_with_their_text(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(written(BOOK))
    got = {r.page_number: r for r in pdf.read_pdf(spark, str(tmp_path)).collect()}
    assert {n: r.text for n, r in got.items()} == {1: "Adi Parva\nSECTION I\nWords apart\nsecond line", 2: "AB C\nÉb", 4: "last page café"}
    assert got[1].has_section_marker and got[1].has_parva_marker and got[1].word_count == 8 and got[1].metadata.title == "A (small) book" and got[1].metadata.producer == "hand"


def test_objects_in_streams(spark, tmp_path):
    inner = {n: BOOK[n] for n in (1, 2, 3, 7)}
    offsets, body = [], b""
    for n, o in inner.items():
        offsets.append(b"%d %d" % (n, len(body)))
        body += o + b" "
    head = b" ".join(offsets) + b" "
    outer = {30: stream(head + body, more=b"/Type /ObjStm /N 4 /First %d " % len(head)), 10: BOOK[10], 11: BOOK[11], 31: stream(b"", more=b"/Type /XRef /Root 1 0 R ")}
    (tmp_path / "b.pdf").write_bytes(written(outer, b"<< >>"))
    assert [r.text for r in pdf.read_pdf(spark, str(tmp_path)).collect()] == ["Adi Parva\nSECTION I\nWords apart\nsecond line"]


@pytest.mark.parametrize("data", [b"no file", written(BOOK, b"<< /Root 1 0 R /Encrypt 5 0 R >>")])
def test_what_is_no_readable_file_is_an_error(data):
    with pytest.raises(ValueError):
        pdf.File(data)
