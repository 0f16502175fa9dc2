"""Pages of PDF files as text: objects and streams (plain or deflated, also in object streams), the page tree, and the
text that content streams show, by a font's Unicode table where it has one and by its single-byte codes else.

What is scanned is text that a file holds as text; pictures of text have none. Encrypted files are an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[-+.\d]+|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
NUMBER = re.compile(rb"[-+]?\d*\.?\d+|[-+]?\d+\.")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """A reference to an object."""


class Name(str):
    """A name, without its slash."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets that begins after ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            more = re.match(rb"\\([0-7]{1,3}|\r\n|.)", data[at:], re.S)
            if more is None:
                break
            at += more.end()
            if more[1][:1].isdigit() and more[1] < b"8":
                out.append(int(more[1], 8) & 255)
            elif more[1] not in (b"\n", b"\r", b"\r\n"):
                out += ESCAPES.get(more[1], more[1])
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(token, end): numbers, names, strings (bytes), and marks and operators (str)."""
    while (m := TOKEN.search(data, at)) is not None:
        t, at = m[0], m.end()
        if t.startswith(b"%"):
            continue
        if t == b"(":
            value, at = literal(data, at)
            yield value, at
        elif t.startswith(b"/"):
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1")), at
        elif t.startswith(b"<") and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        elif NUMBER.fullmatch(t):
            yield float(t) if b"." in t else int(t), at
        else:
            yield t.decode("latin-1"), at


def value_at(data: bytes, at: int) -> tuple[object, int]:
    """The object that begins at ``at``, and where it ends."""
    stack: list[list] = [[]]
    for t, end in tokens(data, at):
        if t in ("<<", "["):
            stack.append([t])
            continue
        if t in (">>", "]"):
            items = stack.pop()[1:]
            t = dict(zip(items[::2], items[1::2])) if t == ">>" else items
        elif t == "R" and type(t) is str and len(stack[-1]) >= 2 and isinstance(stack[-1][-2], int):
            stack[-1].pop()
            t = Ref(stack[-1].pop())
        elif type(t) is str:
            t = {"true": True, "false": False, "null": None}.get(t, t)
        if not stack:
            return None, end
        stack[-1].append(t)
        if len(stack) == 1:
            following = re.match(rb"\s+\d+\s+R\b", data[end : end + 32]) if type(t) is int else None
            if following is None:
                return stack[0][0], end
            return Ref(t), end + following.end()
    return (stack[0] or [None])[0], len(data)


class File:
    """The objects of a file by number; of a number's versions the last one."""

    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        trailer: dict = {}
        at = 0
        while (m := OBJECT.search(data, at)) is not None:
            number = int(m[1])
            value, at = value_at(data, m.end())
            self.objects[number] = value
            begin = re.match(rb"\s*stream\r?\n", data[at : at + 64])
            if isinstance(value, dict) and begin:
                start, size = at + begin.end(), self.get(value.get("Length"))
                if not isinstance(size, int) or not re.match(rb"\s*endstream", data[start + size : start + size + 32]):
                    size = max(0, data.find(b"endstream", start) - start)
                self.streams[number] = data[start : start + size]
                at = start + size
                if value.get("Type") == "XRef":
                    trailer |= value
        for m in re.finditer(rb"\btrailer\s*(?=<<)", data):
            trailer |= value_at(data, m.end())[0] or {}
        if "Encrypt" in trailer:
            raise ValueError("the file is encrypted")
        for number in [n for n, v in self.objects.items() if isinstance(v, dict) and v.get("Type") == "ObjStm" and n in self.streams]:
            inner, head = self.stream(number), self.objects[number]
            numbers = [t for t, _ in tokens(inner[: head["First"]])]
            for n, offset in zip(numbers[::2], numbers[1::2]):
                self.objects.setdefault(n, value_at(inner, head["First"] + offset)[0])
        self.root, self.info = self.get(trailer.get("Root")), self.get(trailer.get("Info"))
        if not isinstance(self.root, dict):
            self.root = next((v for v in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})

    def get(self, value):
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value))
        return value

    def stream(self, number: int) -> bytes:
        data, head = self.streams.get(number, b""), self.objects.get(number)
        filters = self.get(head.get("Filter")) if isinstance(head, dict) else None
        for f in [filters] if isinstance(filters, str) else filters or []:
            if f not in ("FlateDecode", "Fl"):
                return b""
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with the resources that they inherit."""
        waiting, seen = [(self.root.get("Pages"), {})], set()
        while waiting:
            ref, above = waiting.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                continue
            seen.add(ref) if isinstance(ref, Ref) else None
            own = above | ({"Resources": node["Resources"]} if "Resources" in node else {})
            if "Kids" in node:
                waiting += [(k, own) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield own | node

    def contents(self, page: dict) -> bytes:
        parts = page.get("Contents")
        parts = parts if isinstance(self.get(parts), dict) else self.get(parts)
        return b"\n".join(self.stream(int(p)) for p in (parts if isinstance(parts, list) else [parts]) if isinstance(p, Ref))


def unicode_table(cmap: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code and its characters, from a font's Unicode table."""
    table, width, held = {}, 1, []
    text = lambda b: b.decode("utf-16-be", "replace")
    for t, _ in tokens(cmap):
        if t == "endcodespacerange":
            width = len(held[0]) if held and isinstance(held[0], bytes) else 1
        elif t == "endbfchar":
            table |= {int.from_bytes(a): text(b) for a, b in zip(held[::2], held[1::2])}
        elif t == "endbfrange":
            at = 0
            while at + 2 < len(held):
                low, high = int.from_bytes(held[at]), int.from_bytes(held[at + 1])
                if held[at + 2] == "[":
                    end = held.index("]", at)
                    table |= {low + k: text(b) for k, b in enumerate(held[at + 3 : end])}
                    at = end + 1
                else:
                    first = held[at + 2]
                    table |= {low + k: text(first[:-2] + (int.from_bytes(first[-2:]) + k).to_bytes(2)) for k in range(high - low + 1)}
                    at += 3
        if type(t) is str and t not in ("[", "]"):
            held = []
        else:
            held.append(t)
    return width, table


def page_text(file: File, page: dict) -> str:
    """Shown strings; a new line where the text moves down, a space where it moves far to the right."""
    resources = file.get(page.get("Resources")) or {}
    fonts = {}
    for name, ref in (file.get(resources.get("Font")) or {}).items():
        font = file.get(ref)
        table = font.get("ToUnicode") if isinstance(font, dict) else None
        fonts[name] = unicode_table(file.stream(int(table))) if isinstance(table, Ref) else (1, None)
    out: list[str] = []
    width, table = 1, None
    stack: list = []

    def show(b: bytes) -> None:
        if table is None:
            out.append(b.decode("cp1252", "replace"))
        else:
            out.append("".join(table.get(int.from_bytes(b[k : k + width]), "") for k in range(0, len(b), width)))

    def newline() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for t, _ in tokens(file.contents(page)):
        if type(t) is not str or t in ("[", "]"):
            stack.append(t)
            continue
        if t in ("'", '"'):
            newline()
        if t in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
            show(stack[-1])
        elif t == "TJ":
            for x in stack:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, (int, float)) and x < -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        elif t in ("T*", "Tm", "BT") or (t in ("Td", "TD") and len(stack) >= 2 and stack[-1]):
            newline()
        elif t in ("Td", "TD") and out and not out[-1].endswith((" ", "\n")):
            out.append(" ")
        elif t == "Tf" and len(stack) >= 2:
            width, table = fonts.get(stack[-2], (1, None))
        stack.clear()
    return "".join(out)


SCHEMA = "path string, page_number int, text string, metadata struct<producer:string,title:string>"


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to a row a page."""
    kind = pa.struct([("producer", pa.string()), ("title", pa.string())])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            file = File(content.as_py())
            info = file.info if isinstance(file.info, dict) else {}
            said = {k: v.decode("utf-16" if v[:2] in (b"\xfe\xff", b"\xff\xfe") else "latin-1", "replace") if isinstance(v := file.get(info.get(k.title())), bytes) else None for k in ("producer", "title")}
            texts = [page_text(file, page) for page in file.pages()]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts), pa.string()), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string()), pa.array([said] * len(texts), kind)], names=["path", "page_number", "text", "metadata"])


def pages_of(files: DataFrame, **cleaning) -> DataFrame:
    """Pages of PDF files (path, content): cleaned, numbered from 1, those without text left out, with their metrics."""
    found = files.select("path", "content").mapInArrow(parsed, SCHEMA)
    cleaned = found.withColumn("text", T.page_clean(F.col("text"), **cleaning)).where(F.trim("text") != "")
    upper = F.upper("text")
    return cleaned.select("path", "page_number", "text", T.word_count(F.col("text")).alias("word_count"), upper.contains("SECTION").alias("has_section_marker"), upper.contains("PARVA").alias("has_parva_marker"), "metadata")


def read_pdf(spark: SparkSession, path: str, **cleaning) -> DataFrame:
    """Pages of the PDF files in a path; a file is one task and has to fit in a row (2 GB)."""
    return pages_of(spark.read.format("binaryFile").load(path), **cleaning)
