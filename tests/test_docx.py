"""Word and OpenDocument files."""

import io
import zipfile

import pytest

from proseframe.sources import docx

NOTES = f'<w:footnotes xmlns:w="{docx.W[1:-1]}"><w:footnote w:id="-1"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>See &amp; read</w:t></w:r></w:p></w:footnote></w:footnotes>'.encode()
RUNS = [(None, [{"text": "Bold ", "bold": True}, {"text": None, "note_ref": "2"}, {"text": "<plain> & \ttext"}]), ("Heading1", [{"text": "Head", "italic": True}])]


def write(folder, name="a.docx"):
    p = folder / name
    p.write_bytes(docx.container({"word/document.xml": docx.document_xml(RUNS).encode(), "word/footnotes.xml": NOTES}))
    return p


def test_source(spark, tmp_path):
    write(tmp_path), write(tmp_path, "b.docx")
    docx.register(spark)
    read = lambda part: spark.read.format("docx").option("part", part).load(str(tmp_path)).where("doc_id = 'a'").collect()
    runs = read("runs")
    assert [(r["text"], r["bold"], r["italic"], r["kind"]) for r in runs] == [("Bold ", True, None, "text"), (None, None, None, "footnote_ref"), ("<plain> & \ttext", None, None, "text"), ("Head", None, True, "text")]
    paras = read("paragraphs")
    assert paras[0]["text"] == "Bold §FOOTNOTE:2§<plain> & \ttext" and paras[1]["style"] == "Heading1"
    assert [(n["note_id"], n["text"]) for n in read("notes")] == [(2, "See & read")]
    assert {p["name"] for p in read("parts")} >= {"word/document.xml", "[Content_Types].xml"}
    assert read("relations")[0]["target"] == "word/document.xml" and read("styles") == [] and read("headers") == []
    same = docx.read_binary(spark, str(tmp_path), "runs").where("doc_id = 'a'").collect()
    assert [r["text"] for r in same] == [r["text"] for r in runs]


def test_tables_and_boxes():
    w = docx.W[1:-1]
    xml = f'<w:document xmlns:w="{w}"><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:drawing><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></w:drawing></w:r></w:p></w:body></w:document>'
    rows = list(docx.read_rows("d", docx.container({"word/document.xml": xml.encode()}), "paragraphs"))
    assert [(r[2], r[4], r[5]) for r in rows] == [("cell", True, False), ("", False, True), ("box", False, False)]


def test_bad_and_overlay(tmp_path):
    with pytest.raises(ValueError):
        list(docx.read_rows("d", b"no", "runs"))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("x", "y")
    with pytest.raises(ValueError):
        list(docx.read_rows("d", buf.getvalue(), "runs"))
    old = write(tmp_path).read_bytes()
    new = docx.overlay(old, {"word/document.xml": docx.document_xml([(None, [{"text": "new"}])]).encode()})
    assert [r[3] for r in docx.read_rows("d", new, "runs")] == ["new"] and list(docx.read_rows("d", new, "notes"))


def test_links_and_highlights(spark, tmp_path):
    doc = docx.with_note_links(docx.text_to_document("a"), [("rId1", "https://a.org/?x=1&y=2"), ("rId2", "https://b.org")])
    doc = docx.with_note_links(doc, [("rId2", "https://other.org"), ("rId3", "https://c.org")])
    rels = {r[1]: r for r in docx.read_rows("t", doc, "parts")}
    xml = docx._open(doc).read("word/_rels/footnotes.xml.rels").decode()
    assert [x in xml for x in ("https://a.org/?x=1&amp;y=2", "https://b.org", "https://other.org", "https://c.org", 'TargetMode="External"')] == [True, True, False, True, True] and rels
    d = spark.createDataFrame([("h", 0, 0, "same ", None, None, None, None, False), ("h", 0, 1, "new", None, None, None, None, True)], "doc_id string, para_idx int, run_idx int, text string, bold boolean, italic boolean, note_ref string, style string, highlight boolean")
    docx.write_documents(d, "file:" + str(tmp_path / "hl"))
    body = docx._open((tmp_path / "hl" / "h.docx").read_bytes()).read("word/document.xml").decode()
    assert body.count("<w:highlight") == 1 and body.index("<w:highlight") > body.index("same ")


def test_write_and_text(spark, tmp_path):
    d = spark.createDataFrame([("x", 0, 0, "a", True, None, None, None), ("x", 0, 1, None, None, None, "3", None), ("x", 1, 0, "b", None, True, None, "Title"), ("y", 0, 0, "", None, None, None, None)], "doc_id string, para_idx int, run_idx int, text string, bold boolean, italic boolean, note_ref string, style string")
    docx.write_documents(d, str(tmp_path / "out"))
    docx.register(spark)
    got = spark.read.format("docx").option("part", "paragraphs").load(str(tmp_path / "out")).orderBy("doc_id", "para_idx").collect()
    assert [(r["doc_id"], r["text"], r["style"]) for r in got] == [("x", "a§FOOTNOTE:3§", None), ("x", "b", "Title"), ("y", "", None)]
    assert [r[2] for r in docx.read_rows("t", docx.text_to_document("l1\n\nl3"), "paragraphs")] == ["l1", "", "l3"]
    assert len(list(docx.read_rows("t", docx.text_to_document(""), "paragraphs"))) == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "u.txt").write_bytes("né".encode())
    (tmp_path / "t" / "l.txt").write_bytes("né".encode("latin-1"))
    assert {r["text"] for r in docx.read_texts(spark, str(tmp_path / "t")).collect()} == {"né"}


def test_odt():
    xml = '<office:d xmlns:office="o" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><text:p> one <text:span>two</text:span></text:p></office:d>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("content.xml", xml)
    assert [r[2] for r in docx.read_rows("o", buf.getvalue(), "paragraphs")] == ["one two"]


def test_markers():
    runs = docx.split_markers("a **b** *c* ***d*** 2 * 3 ****")
    assert [(r["text"], r["bold"], r["italic"]) for r in runs if r["bold"] or r["italic"]] == [("b", True, False), ("c", False, True), ("d", True, True)]
    assert "".join(r["text"] for r in docx.split_markers("plain")) == "plain"
    kept = docx.reattach("Bold new plain tail", [{"text": "Bold ", "bold": True}, {"text": "plain"}])
    assert "".join(r["text"] for r in kept) == "Bold new plain tail" and kept[0]["bold"]
    assert docx.reattach("x", []) == [{"text": "x", "bold": False, "italic": False}]
