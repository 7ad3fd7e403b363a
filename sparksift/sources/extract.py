"""Text from file contents, by extension, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from email import message_from_bytes
from xml.etree import ElementTree

from ..operators.html import visible_text

PLAIN = ("cfg", "conf", "csv", "env", "go", "ini", "java", "js", "json", "log", "md", "ts", "txt", "xml", "yaml", "yml")
EXTRACTABLE = frozenset((*PLAIN, "html", "htm", "docx", "xlsx", "pdf", "eml"))


def plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


def docx(content: bytes) -> str:
    """All character data of the main part, trimmed, one per line; nothing if there is no such part."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            return ""
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join(t.strip() for t in root.itertext() if t.strip())


def xlsx(content: bytes) -> str:
    """The cells that show something, sheet by sheet and row by row, one per line."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter() if local(t) == "t") for item in root if local(item) == "si"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for name in sheets:
            for cell in (e for e in ElementTree.fromstring(z.read(name)).iter() if local(e) == "c"):
                value = "".join(t.text or "" for t in cell.iter() if local(t) in ("v", "t"))
                if cell.get("t") == "s" and value:
                    value = shared[int(value)]
                if value:
                    out.append(value)
    return "\n".join(out)


def eml(content: bytes) -> str:
    """Headers as `name: value` lines in order of name, an empty line, and the raw body."""
    message = message_from_bytes(content)
    headers = sorted(f"{k}: {v}" for k, v in message.items())
    body = re.split(rb"\r?\n\r?\n", content, maxsplit=1)
    return "\n".join(headers) + "\n\n" + (body[1].decode("utf-8", "replace") if len(body) > 1 else "")


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        e = m.group(1)
        return bytes([int(e, 8) & 255]) if e[:1].isdigit() else _ESCAPES.get(e, e)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S).decode("latin-1")


def pdf(content: bytes) -> str:
    """Strings that the text operators of plain or deflated content streams show. Fonts with their own encodings come out as their bytes."""
    if b"/Encrypt" in content:
        raise ValueError("the PDF is encrypted")
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\n?endstream", content, re.S):
        data = m.group(1)
        try:
            data = zlib.decompress(data)
        except zlib.error:
            pass
        for block in re.findall(rb"BT\b(.*?)\bET", data, re.S):
            for shown in re.finditer(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")", block, re.S):
                parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", shown.group(1), re.S) if shown.group(1) is not None else [shown.group(2)]
                out.append("".join(_literal(p) for p in parts))
    return "\n".join(t for t in out if t.strip())


def extract(ext: str, content: bytes) -> str:
    if ext in ("html", "htm"):
        return visible_text(plain(content)) or ""
    return {"docx": docx, "xlsx": xlsx, "eml": eml, "pdf": pdf}.get(ext, plain)(content)
