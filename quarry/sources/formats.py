"""What is in a file's bytes: its content type, the members of containers, and the text of office documents and mails."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from xml.etree import ElementTree

#: Containers in containers, and bytes of all members of a file together, at most.
MOST_DEPTH, MOST_BYTES = 4, 100 << 20
#: Between a container's path and a member's.
WITHIN = "!/"

# First bytes of formats, and content types of extensions.
MAGIC = [(b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"PK\x03\x04", "application/zip"), (b"PK\x05\x06", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"Rar!\x1a\x07", "application/vnd.rar"), (b"{\\rtf", "application/rtf"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "application/x-ole-storage")]
TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "odt": "application/vnd.oasis.opendocument.text", "epub": "application/epub+zip",
    "eml": "message/rfc822", "md": "text/markdown", "html": "text/html", "css": "text/css", "csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "xml": "application/xml", "svg": "image/svg+xml",
}


class TooLarge(ValueError):
    pass


def content_type(data: bytes, extension: str = "") -> str:
    """By first bytes; zip-based and text formats then by their parts or extension."""
    for first, kind in MAGIC:
        if data.startswith(first):
            if kind != "application/zip":
                return kind
            try:
                names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
            except zipfile.BadZipFile:
                return kind
            for part, ext in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("META-INF/container.xml", "epub")):
                if part in names:
                    return TYPES[ext]
            return TYPES["odt"] if {"mimetype", "content.xml"} <= names else kind
    if data[257:262] == b"ustar":
        return "application/x-tar"
    if b"\0" in data:
        return "application/octet-stream"
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return TYPES.get(extension, "application/octet-stream")
    start = text.lstrip("﻿ \t\r\n")[:400].lower()
    if start.startswith(("<!doctype html", "<html")):
        return "text/html"
    if start.startswith("<?xml"):
        return TYPES["svg"] if "<svg" in start else TYPES["xml"]
    return TYPES.get(extension, "text/plain")


def _read(stream, left: list[int]) -> bytes:
    """A member's bytes, of those that are left for all."""
    data = stream.read(left[0] + 1)
    if len(data) > left[0]:
        raise TooLarge(f"members of more than {MOST_BYTES} bytes")
    left[0] -= len(data)
    return data


def _attachments(data: bytes) -> Iterator[tuple[str, bytes]]:
    for i, part in enumerate(message_from_bytes(data, policy=policy.default).iter_attachments()):
        body = part.get_content() if part.get_content_maintype() != "multipart" else part.as_bytes()
        body = body.encode() if isinstance(body, str) else body.as_bytes() if hasattr(body, "as_bytes") else body
        yield part.get_filename() or f"part-{i + 1}.{'eml' if part.get_content_type() == 'message/rfc822' else 'bin'}", body


def _direct(data: bytes, name: str, left: list[int]) -> Iterator[tuple[str, bytes]]:
    kind = content_type(data, name.rpartition(".")[2].lower())
    if kind == "application/zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir() and not info.flag_bits & 1:  # encrypted ones cannot be read
                    with z.open(info) as f:
                        yield info.filename, _read(f, left)
    elif kind == "application/x-tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    yield info.name.removeprefix("./"), _read(t.extractfile(info), left)
    elif kind == "application/gzip":
        inner = name.rpartition("/")[2]
        inner = inner[:-3] if inner.lower().endswith(".gz") else inner[:-4] + ".tar" if inner.lower().endswith(".tgz") else inner + ".out"
        with gzip.open(io.BytesIO(data)) as f:
            yield inner, _read(f, left)
    elif kind == TYPES["eml"]:
        for inner, body in _attachments(data):
            yield inner, _read(io.BytesIO(body), left)


def members(data: bytes, name: str) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of what zip, tar, gz and mail files hold, containers in them included, MOST_DEPTH deep; office files are no containers. Raises
    TooLarge beyond MOST_BYTES in all, and what a broken file raises."""
    left, open_ = [MOST_BYTES], [(name, data, 0)]
    while open_:
        path, body, depth = open_.pop()
        if depth >= MOST_DEPTH:
            continue
        for inner, own in _direct(body, path, left):
            yield f"{path}{WITHIN}{inner}", own
            open_.append((f"{path}{WITHIN}{inner}", own, depth + 1))


# ---- text of formats


def _xml(z: zipfile.ZipFile, part: str, left: list[int]) -> ElementTree.Element:
    with z.open(part) as f:
        return ElementTree.fromstring(_read(f, left))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _lines(root: ElementTree.Element, block: set[str], text: set[str] | None = None) -> list[str]:
    """The text of each block, of elements named text if given; of blocks within blocks once, each for itself."""

    def own(e: ElementTree.Element) -> str:
        out = (e.text or "") if text is None or _local(e) in text else {"tab": "\t", "br": "\n"}.get(_local(e), "")
        for x in e:
            out += ("" if _local(x) in block else own(x)) + ((x.tail or "") if text is None else "")
        return out

    return [line for line in (own(e) for e in root.iter() if _local(e) in block) if line.strip()]


def _title(z: zipfile.ZipFile, part: str, left: list[int]) -> str | None:
    if part not in z.namelist():
        return None
    return next((x.text.strip() for x in _xml(z, part, left).iter() if _local(x) == "title" and x.text and x.text.strip()), None)


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), m[0]) for m in (re.fullmatch(pattern, n) for n in z.namelist()) if m]
    return [n for _, n in sorted(found)]


def docx(data: bytes) -> tuple[str, str | None]:
    left = [MOST_BYTES]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = ["word/document.xml", *(n for n in ("word/footnotes.xml", "word/endnotes.xml") if n in z.namelist())]
        return "\n".join(x for p in parts for x in _lines(_xml(z, p, left), {"p"}, {"t"})), _title(z, "docProps/core.xml", left)


def xlsx(data: bytes) -> tuple[str, str | None]:
    left = [MOST_BYTES]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(z, "xl/sharedStrings.xml", left) if _local(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for sheet in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
            for row in (e for e in _xml(z, sheet, left).iter() if _local(e) == "row"):
                cells = []
                for c in (e for e in row if _local(e) == "c"):
                    value = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append("\t".join(cells))
        return "\n".join(rows), _title(z, "docProps/core.xml", left)


def pptx(data: bytes) -> tuple[str, str | None]:
    left = [MOST_BYTES]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(x for s in _numbered(z, r"ppt/slides/slide(\d+)\.xml") for x in _lines(_xml(z, s, left), {"p"}, {"t"})), _title(z, "docProps/core.xml", left)


def odt(data: bytes) -> tuple[str, str | None]:
    left = [MOST_BYTES]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(_lines(_xml(z, "content.xml", left), {"p", "h"})), _title(z, "meta.xml", left)


def epub(data: bytes) -> tuple[str, str | None]:
    from quarry.sources.files import html

    left = [MOST_BYTES]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        package = next(e.get("full-path") for e in _xml(z, "META-INF/container.xml", left).iter() if _local(e) == "rootfile")
        base, root = package.rpartition("/")[0], _xml(z, package, left)
        items = {e.get("id"): e.get("href") for e in root.iter() if _local(e) == "item"}
        texts = []
        for ref in (e.get("idref") for e in root.iter() if _local(e) == "itemref"):
            with z.open(f"{base}/{items[ref]}" if base else items[ref]) as f:
                texts.append(html(_read(f, left))[0])
        return "\n".join(texts), _title(z, package, left)


def mail(data: bytes) -> tuple[str, str | None]:
    from quarry.sources.files import html

    m = message_from_bytes(data, policy=policy.default)
    body = m.get_body(("plain", "html"))
    text = "" if body is None else body.get_content()
    return html(text.encode())[0] if body is not None and body.get_content_subtype() == "html" else text, m["subject"]


def listing(name: str):
    """A container's text is the names of its members."""

    def names(data: bytes) -> tuple[str, str | None]:
        return "\n".join(p.removeprefix(name + WITHIN) for p, _ in members(data, name)), None

    return names
