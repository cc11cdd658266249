"""Text of files, by format, in Arrow batches. Formats whose library is missing give an error row, never a failed job."""

from __future__ import annotations

import contextlib
import csv
import ctypes
import io
import json
import multiprocessing
import re
import signal
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import normalize_text, suffix
from docloom.operators.tables import bounded, pieces

#: Suffixes of plain text.
PLAIN = (".txt .md .markdown .log .py .js .jsx .ts .tsx .vue .svelte .css .scss .sass .less .java .go .rs .rb .php .c .h .cpp .hpp .cs .swift .kt .m .mm .sh .bash .zsh .ps1 .bat .yaml .yml .toml .ini .cfg .sql .xml").split()


def decode(raw: bytes) -> str:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("the encoding is unknown")


def rows_text(rows: list[list[str]]) -> str:
    stripped = ([c.strip() for c in r] for r in rows)
    return "\n".join("\t".join(r) for r in stripped if any(r))


def from_csv(raw: bytes) -> str:
    return rows_text(list(csv.reader(io.StringIO(decode(raw)))))


def from_json(raw: bytes) -> str:
    return json.dumps(json.loads(decode(raw)), indent=2, ensure_ascii=False)


class Visible(HTMLParser):
    """Text outside scripts and styles."""

    HIDDEN = ("script", "style", "noscript")

    def __init__(self) -> None:
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def from_html(raw: bytes) -> str:
    parser = Visible()
    parser.feed(decode(raw))
    parser.close()
    return "\n".join(parser.parts)


def tag_of(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def sheet_text(name: str, rows: list[list[str]]) -> str:
    body = rows_text(rows)
    return f"[sheet: {name}]\n{body}" if body else ""


def from_xlsx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if tag_of(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in (n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag_of(n) == "sheet"):
            target = links[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/")
            sheet = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in (n for n in sheet.iter() if tag_of(n) == "row"):
                cells: list[str] = []
                for c in row:
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = "".join(t.text or "" for t in c.iter() if tag_of(t) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append(cells)
            out.append(sheet_text(s.get("name", ""), rows))
    return "\n\n".join(x for x in out if x)


def from_spreadsheet_xml(raw: bytes) -> str:
    text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;", decode(raw))  # no other entity is known to XML
    text = re.sub(r"^<\?xml[^>]*\?>", "", text.lstrip())
    attribute = lambda n, name: next((v for k, v in n.attrib.items() if k.rpartition("}")[2] == name), "")
    sheets = (n for n in ElementTree.fromstring(text).iter() if tag_of(n) == "Worksheet")
    out = [sheet_text(attribute(s, "Name"), [["".join(c.itertext()) for c in r if tag_of(c) == "Cell"] for r in s.iter() if tag_of(r) == "Row"]) for s in sheets]
    return "\n\n".join(x for x in out if x)


def from_docx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    text = lambda n: "".join((t.text or "") if tag_of(t) == "t" else "\t" if tag_of(t) == "tab" else "" for t in n.iter())
    paragraphs = [text(p) for p in body if tag_of(p) == "p"]
    rows = ["\t".join(text(c).strip() for c in r if tag_of(c) == "tc") for t in body if tag_of(t) == "tbl" for r in t if tag_of(r) == "tr"]
    return "\n".join([p for p in paragraphs if p.strip()] + rows)


def from_xls(raw: bytes) -> str:
    return XLS[xls_kind(raw)](raw)


def xls_kind(raw: bytes) -> str:
    """What a file that is called .xls holds."""
    return "openpyxl-compatible" if raw[:2] == b"PK" else "xml-SpreadsheetML" if raw.lstrip()[:5] == b"<?xml" else "xlrd"


def from_ole_xls(raw: bytes) -> str:
    import xlrd

    book = xlrd.open_workbook(file_contents=raw)
    show = lambda c, mode: str(xlrd.xldate_as_datetime(c.value, mode)) if c.ctype == xlrd.XL_CELL_DATE else str(c.value)
    out = [sheet_text(s.name, [[show(c, book.datemode) for c in s.row(i)] for i in range(s.nrows)]) for s in book.sheets()]
    return "\n\n".join(x for x in out if x)


XLS: dict[str, Callable[[bytes], str]] = {"openpyxl-compatible": from_xlsx, "xml-SpreadsheetML": from_spreadsheet_xml, "xlrd": from_ole_xls}


def from_pdf(raw: bytes) -> str:
    import fitz

    with fitz.open(stream=raw, filetype="pdf") as doc:
        return "\n\n".join(page.get_text() for page in doc)


def from_doc(raw: bytes) -> str:
    import olefile

    with olefile.OleFileIO(io.BytesIO(raw)) as ole:
        text = ole.openstream("WordDocument").read().decode("utf-16-le", "ignore")
    return "\n".join(re.findall(r"[^\x00-\x08\x0e-\x1f�]{4,}", re.sub("[\r\x0b\x0c]", "\n", text)))


#: suffix: name of the extractor, function.
EXTRACTORS: dict[str, tuple[str, Callable[[bytes], str]]] = {
    **{s: ("plain-text", decode) for s in PLAIN},
    ".csv": ("python-csv", from_csv), ".json": ("json", from_json), ".html": ("html-parser", from_html), ".htm": ("html-parser", from_html),
    ".xlsx": ("openpyxl-compatible", from_xlsx), ".xls": ("xlrd-or-xml", from_xls), ".docx": ("docx-xml", from_docx), ".doc": ("olefile", from_doc), ".pdf": ("pymupdf", from_pdf),
}


#: Seconds that one file may take.
TIME_LIMIT_S = 30


class Reader:
    """Reads files in a process of its own, which is ended where a file takes too long, and replaced for the next one.

    So nothing goes on after the limit, not even code of a library that cannot be interrupted, and a reader that
    takes its process down costs one file only.
    """

    def __init__(self, known: dict[str, tuple[str, Callable[[bytes], str]]]):
        self.known, self.process, self.pipe = known, None, None

    def start(self) -> None:
        forks = multiprocessing.get_context("fork")
        self.pipe, theirs = forks.Pipe()
        self.process = forks.Process(target=self.serve, args=(self.pipe, theirs), daemon=True)
        self.process.start()
        theirs.close()

    def serve(self, ours, theirs) -> None:
        ours.close()  # so that the pipe ends with the task
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).prctl(1, signal.SIGKILL)  # and the process with its parent, where the system can do that
        with contextlib.suppress(EOFError, BrokenPipeError):
            while True:
                ext, raw = theirs.recv()
                try:
                    theirs.send((self.known[ext][1](raw), None))
                except Exception as e:  # a broken file is a row, not a failed job
                    theirs.send((None, f"{type(e).__name__}: {e}"))

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = None

    def read(self, ext: str, raw: bytes, seconds: float) -> tuple[str | None, str | None]:
        """The text, or an error."""
        if self.process is None:
            self.start()
        try:
            self.pipe.send((ext, raw))
            if self.pipe.poll(seconds):
                return self.pipe.recv()
            error = f"TimeoutError: over {seconds} s"
        except (EOFError, OSError):
            error = "ChildProcessError: the reader ended without an answer"
        self.stop()
        return None, error


def extract(files: DataFrame, time_limit_s: float = TIME_LIMIT_S, extractors: dict[str, tuple[str, Callable[[bytes], str]]] | None = None) -> DataFrame:
    """(path, status, extractor_name, full_text, char_count, error) for files (path, content)."""
    known = EXTRACTORS if extractors is None else extractors

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(known)
        try:
            for b in (p for whole in it for p in pieces(whole, 2)):
                out = []
                for ext, content in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                    raw = content.as_py() or b""
                    name, read = known.get(ext, (None, None))
                    text = error = None
                    if read is not None:
                        name = xls_kind(raw) if read is from_xls else name
                        text, error = reader.read(ext, raw, time_limit_s)
                    out.append((name, text, error))
                names, texts, errors = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (names, texts, errors))], ["path", "extractor_name", "text", "error"])
        finally:
            reader.stop()

    raw = bounded(files).select("path", suffix(F.col("path")).alias("ext"), "content").mapInArrow(batches, "path string, extractor_name string, text string, error string")
    text = normalize_text(F.coalesce("text", F.lit("")))
    status = F.when(F.col("extractor_name").isNull(), "unsupported").when(F.col("error").isNotNull(), "error").when(F.col("full_text") == "", "no_text").otherwise("success")
    return raw.withColumn("full_text", text).select("path", status.alias("status"), "extractor_name", "full_text", F.length("full_text").cast("long").alias("char_count"), "error")


def visible_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, text) of HTML."""
    named = pages.select(F.concat(F.col(key).cast("string"), F.lit(".html")).alias("path"), F.col(html).cast("binary").alias("content"))
    return extract(named).select(F.regexp_replace("path", r"\.html$", "").cast("long").alias(key), "status", F.col("full_text").alias("text"))
