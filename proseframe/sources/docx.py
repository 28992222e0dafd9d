"""Word and OpenDocument files: a data source that reads them as rows, and a writer.

spark.read.format("docx").load(dir) gives runs; option("part", ...) one of runs, paragraphs, notes,
parts, relations, styles, headers. Files are partitions, so a folder is read by as many tasks as it
has files; `files_per_task` groups small ones. Only the standard library is used.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/package/2006/relationships}"
T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
NOT_TEXT = {"fldChar": "field", "instrText": "field", "drawing": "image", "pict": "image", "footnoteReference": "footnote_ref", "endnoteReference": "endnote_ref"}
SCHEMAS = {
    "runs": "doc_id string, para_idx int, run_idx int, text string, bold boolean, italic boolean, superscript boolean, kind string, note_ref string",
    "paragraphs": "doc_id string, para_idx int, text string, style string, in_table boolean, has_image boolean",
    "notes": "doc_id string, kind string, note_id int, text string",
    "parts": "doc_id string, name string, content binary",
    "relations": "doc_id string, part string, rel_id string, type string, target string, mode string",
    "styles": "doc_id string, style_id string, name string, bold boolean",
    "headers": "doc_id string, part string, text string",
}


def _on(props: ET.Element | None, tag: str) -> bool | None:
    e = props.find(W + tag) if props is not None else None
    return None if e is None else e.get(W + "val", "1") not in ("0", "false", "off", "none")


def _run_text(run: ET.Element) -> str:
    out = []
    for e in run:
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag in (W + "tab",):
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _open(data: bytes) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not a Word or OpenDocument file") from e
    if not {"word/document.xml", "content.xml"} & set(z.namelist()):
        raise ValueError("the file has no word/document.xml")
    return z


def _paragraphs(root: ET.Element) -> Iterator[tuple[ET.Element, bool]]:
    """Every w:p in reading order, and whether a table holds it."""

    def walk(e: ET.Element, table: bool) -> Iterator[tuple[ET.Element, bool]]:
        for c in e:
            if c.tag == W + "p":
                yield c, table
            yield from walk(c, table or c.tag == W + "tbl")

    yield from walk(root, False)


def _own_runs(p: ET.Element) -> Iterator[ET.Element]:
    """The runs of a paragraph, but not those of a paragraph inside it."""
    for c in p:
        if c.tag == W + "r":
            yield c
        elif c.tag != W + "p" and c.tag != W + "pPr":
            yield from _own_runs(c)


def read_rows(doc_id: str, data: bytes, part: str) -> Iterator[tuple]:
    """Rows of one file."""
    z = _open(data)
    names = set(z.namelist())
    if part == "parts":
        for n in z.namelist():
            yield doc_id, n, z.read(n)
        return
    if part == "relations":
        for n in sorted(names):
            if n.endswith(".rels"):
                for r in ET.fromstring(z.read(n)).iter(R + "Relationship"):
                    yield doc_id, n, r.get("Id"), r.get("Type"), r.get("Target"), r.get("TargetMode")
        return
    if part == "styles":
        if "word/styles.xml" in names:
            for s in ET.fromstring(z.read("word/styles.xml")).iter(W + "style"):
                n = s.find(W + "name")
                yield doc_id, s.get(W + "styleId"), None if n is None else n.get(W + "val"), bool(_on(s.find(W + "rPr"), "b"))
        return
    if part == "headers":
        for n in sorted(names):
            if re.fullmatch(r"word/(header|footer)\d*\.xml", n):
                for p, _ in _paragraphs(ET.fromstring(z.read(n))):
                    yield doc_id, n, "".join(_run_text(r) for r in _own_runs(p)).strip()
        return
    if part == "notes":
        for n, kind in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
            if n in names:
                for e in ET.fromstring(z.read(n)).iter(W + kind):
                    i = int(e.get(W + "id", "0"))
                    text = "".join(_run_text(r) for r in e.iter(W + "r")).strip()
                    if i not in (-1, 0) and text:
                        yield doc_id, kind, i, text
        return
    if "content.xml" in names and "word/document.xml" not in names:
        for i, p in enumerate(ET.fromstring(z.read("content.xml")).iter(T + "p")):
            text = "".join(p.itertext()).strip()
            yield (doc_id, i, text, None, False, False) if part == "paragraphs" else (doc_id, i, 0, text, None, None, None, "text", None)
        return
    for i, (p, table) in enumerate(_paragraphs(ET.fromstring(z.read("word/document.xml")))):
        style = p.find(f"{W}pPr/{W}pStyle")
        texts, image = [], False
        for j, r in enumerate(_own_runs(p)):
            props, kind, ref = r.find(W + "rPr"), "text", None
            for e in r:
                k = NOT_TEXT.get(e.tag.removeprefix(W))
                if k:
                    kind = k
                    ref = e.get(W + "id") if k.endswith("_ref") else ref
                    image |= k == "image"
            text = _run_text(r)
            texts.append(f"§FOOTNOTE:{ref}§" if kind == "footnote_ref" else text)
            if part == "runs":
                v = props.find(W + "vertAlign") if props is not None else None
                yield doc_id, i, j, None if kind.endswith("_ref") else text, _on(props, "b"), _on(props, "i"), v is not None and v.get(W + "val") == "superscript", kind, ref
        if part == "paragraphs":
            yield doc_id, i, "".join(texts), None if style is None else style.get(W + "val"), table, image


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class DocxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.part, self.path = options.get("part", "runs"), options["path"]
        self.group = int(options.get("files_per_task", 8))

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file:")
        found = sorted(f for f in (glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)) if f.endswith((".docx", ".odt")))
        return [_Files(found[i : i + self.group]) for i in range(0, len(found), self.group)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for f in partition.paths:
            with open(f, "rb") as h:
                yield from read_rows(os.path.splitext(os.path.basename(f))[0], h.read(), self.part)


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("part", "runs")]

    def reader(self, schema) -> DocxReader:  # noqa: ANN001
        return DocxReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)


def read_binary(spark: SparkSession, path: str, part: str = "runs") -> DataFrame:
    """The same rows through Spark's own binaryFile source, for any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,odt}").load(path).select("path", "content")

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        cols = [c.split()[0] for c in SCHEMAS[part].split(", ")]
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                yield pd.DataFrame(list(read_rows(os.path.splitext(os.path.basename(p))[0], bytes(c), part)), columns=cols).astype(object)

    return files.mapInPandas(run, SCHEMAS[part])


CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
ROOT_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def run_xml(text: str | None, bold: bool | None = None, italic: bool | None = None, highlight: bool = False, note_ref: str | None = None, font: str = "Calibri", size: int = 24) -> str:
    props = f'<w:rFonts w:ascii="{font}" w:hAnsi="{font}"/>' + "<w:b/>" * bool(bold) + "<w:i/>" * bool(italic) + f'<w:sz w:val="{size}"/>' + '<w:highlight w:val="yellow"/>' * highlight
    body = f'<w:footnoteReference w:id="{note_ref}"/>' if note_ref else f'<w:t xml:space="preserve">{escape(text or "")}</w:t>'
    return f"<w:r><w:rPr>{props}</w:rPr>{body}</w:r>"


def document_xml(paragraphs: list[tuple[str | None, list[dict]]]) -> str:
    """word/document.xml of (style, runs) paragraphs; a run is the arguments of run_xml."""
    out = []
    for style, runs in paragraphs:
        p = f'<w:pPr><w:pStyle w:val="{escape(style)}"/></w:pPr>' if style else ""
        out.append(f"<w:p>{p}{''.join(run_xml(**r) for r in runs)}</w:p>")
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(out) or "<w:p/>"}</w:body></w:document>'


def container(parts: dict[str, bytes]) -> bytes:
    """Parts as a deflated container; what a document must have is added."""
    parts = {"[Content_Types].xml": CONTENT_TYPES.encode(), "_rels/.rels": ROOT_RELS.encode()} | parts
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in parts.items():
            z.writestr(n, c)
    return buf.getvalue()


def overlay(original: bytes, edited: dict[str, bytes]) -> bytes:
    """The original container with the edited parts in place of its own; all else stays."""
    z = _open(original)
    return container({n: edited.get(n, z.read(n)) for n in z.namelist()} | {n: c for n, c in edited.items() if n not in z.namelist()})


def write_documents(runs: DataFrame, folder: str) -> None:
    """One .docx per doc_id, by tasks, into a folder that all executors share: runs(doc_id, para_idx, run_idx, text, bold, italic, note_ref, style) and, if there, highlight."""
    folder = folder.removeprefix("file:")

    def one(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values(["para_idx", "run_idx"])
        paras = []
        for _, g in pdf.groupby("para_idx", sort=True):
            paras.append((g["style"].iloc[0] or None, [{"text": t, "bold": bool(b) if b is not None else None, "italic": bool(i) if i is not None else None, "note_ref": n or None, "highlight": h is True} for t, b, i, n, h in zip(g["text"], g["bold"].astype(object), g["italic"].astype(object), g["note_ref"], g["highlight"].astype(object) if "highlight" in g else [None] * len(g))]))
        path = os.path.join(folder, f"{pdf['doc_id'].iloc[0]}.docx")
        with open(path + ".part", "wb") as f:
            f.write(container({"word/document.xml": document_xml(paras).encode()}))
        os.replace(path + ".part", path)  # a task that runs again leaves a whole file
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "paragraphs": [len(paras)]})

    os.makedirs(folder, exist_ok=True)
    runs.groupBy("doc_id").applyInPandas(one, "doc_id string, paragraphs int").count()


def relationships_xml(links: list[tuple[str, str]], existing: bytes = b"") -> bytes:
    """A relationships part with links (id, address) added to those that it has; one whose id is there already stays as it is."""
    space = "http://schemas.openxmlformats.org/package/2006/relationships"
    root = ET.fromstring(existing) if existing else ET.Element(f"{{{space}}}Relationships")
    have = {r.get("Id") for r in root}
    for rel, target in links:
        if rel not in have:
            ET.SubElement(root, f"{{{space}}}Relationship", Id=rel, Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink", Target=target, TargetMode="External")
    ET.register_namespace("", space)
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def with_note_links(original: bytes, links: list[tuple[str, str]], part: str = "word/_rels/footnotes.xml.rels") -> bytes:
    """The document with links in the relationships of its footnotes."""
    z = _open(original)
    return overlay(original, {part: relationships_xml(links, z.read(part) if part in z.namelist() else b"")})


def text_to_document(text: str) -> bytes:
    """A document of one paragraph per line; an empty text gives one empty paragraph."""
    return container({"word/document.xml": document_xml([(None, [{"text": line}]) for line in text.split("\n")]).encode()})


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (path, text): UTF-8, else Latin-1."""
    from pyspark.sql import functions as F

    b = spark.read.format("binaryFile").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return b.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def split_markers(text: str) -> list[dict]:
    """A marked paragraph as runs: ***both***, **bold**, *italic*, plain; markers without a partner are text."""
    out, at = [], 0
    for m in re.finditer(r"\*\*\*(?=\S)(.+?)\*\*\*(?!\*)|\*\*(?=[^\s*])(.+?)\*\*(?!\*)|(?<!\*)\*(?=[^\s*])([^*]+?)\*(?!\*)", re.sub(r"(?<!\*)\*{4}(?!\*)", "", text), re.S):
        src = m.string
        if m.start() > at:
            out.append({"text": src[at : m.start()], "bold": False, "italic": False})
        out.append({"text": next(g for g in m.groups() if g is not None), "bold": m[3] is None, "italic": m[2] is None})
        at = m.end()
    src = re.sub(r"(?<!\*)\*{4}(?!\*)", "", text)
    if at < len(src):
        out.append({"text": src[at:], "bold": False, "italic": False})
    return out


def reattach(new: str, runs: list[dict]) -> list[dict]:
    """A rewritten text with the formats of the original runs, as far as these are found in order at its head; the rest is one plain run."""
    out, rest = [], new
    for r in runs:
        t = r.get("text") or ""
        if t and rest.startswith(t):
            out.append(dict(r))
            rest = rest[len(t) :]
        elif t and (k := rest.find(t)) > 0:
            out.append({"text": rest[:k], "bold": False, "italic": False})
            out.append(dict(r))
            rest = rest[k + len(t) :]
    if rest or not out:
        out.append({"text": rest, "bold": False, "italic": False})
    return out
