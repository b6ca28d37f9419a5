"""Files as sources: planning a folder, and texts of plain, mail, HTML, DOCX and ODT files."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is stored, what is parsed of it, and the bounds of a file, of its text and of a mail.
STORED = ("txt", "md", "csv", "tsv", "log", "eml", "html", "htm", "docx", "odt", "pdf", "rtf", "png", "jpg", "jpeg", "tif", "tiff")
PARSED = ("txt", "md", "csv", "tsv", "log", "eml", "html", "htm", "docx", "odt")
MAX_FILE, MAX_TEXT, MAX_PLAIN, MAX_FILES, MAX_DEPTH = 64 << 20, 8 << 20, 1 << 20, 20_000, 32
MAX_MAIL_DEPTH, MAX_MAIL_PARTS, MAX_ATTACHMENTS, MAX_ENTRY = 5, 512, 64, 32 << 20


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def plan_folder(listing: DataFrame, root: str) -> DataFrame:
    """path, extension, length, verdict of every file of a listing: take, or why not (hidden, deep, empty, large, unsupported, beyond).

    beyond: after the first MAX_FILES files to take, in order of their paths; that bound is the feature."""
    from pyspark.sql import Window

    rel = F.regexp_replace(F.col("path"), "^[a-z]*:?/*" + re.escape(root.strip("/")) + "/*", "")
    ext = F.lower(F.regexp_extract(rel, r"\.([A-Za-z0-9]+)$", 1))
    why = F.when(rel.rlike(r"(^|/)\."), "hidden").when(F.size(F.split(rel, "/")) > MAX_DEPTH, "deep").when(F.col("length") == 0, "empty")
    why = why.when(F.col("length") > MAX_FILE, "large").when(~ext.isin(*STORED), "unsupported").otherwise("take")
    rows = listing.select("path", ext.alias("extension"), "length", why.alias("verdict"))
    over = rows.filter("verdict = 'take'").orderBy("path").limit(MAX_FILES + 1)
    if over.count() <= MAX_FILES:
        return rows
    last = over.agg(F.max("path")).first()[0]
    return rows.withColumn("verdict", F.when((F.col("verdict") == "take") & (F.col("path") >= last), "beyond").otherwise(F.col("verdict")))


def plain(data: bytes) -> str:
    """UTF-8 text without its mark; ValueError beyond MAX_PLAIN bytes, for other encodings and for NUL."""
    if len(data) > MAX_PLAIN:
        raise ValueError("text too large")
    text = data.decode("utf-8-sig")
    if "\0" in text:
        raise ValueError("NUL in text")
    return text


class _Html(HTMLParser):
    BLOCKS = frozenset("p div br tr li h1 h2 h3 h4 h5 h6 table ul ol section article header footer blockquote pre hr dt dd".split())
    SILENT = frozenset(("script", "style", "head", "template", "noscript"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT
        if tag in self.BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")

    def handle_endtag(self, tag):
        self.silent -= tag in self.SILENT and self.silent > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(re.sub(r"\s+", " ", data))


def html(text: str) -> str:
    """Visible text of a page, blocks on lines of their own."""
    p = _Html()
    p.feed(text)
    p.close()
    lines = (re.sub(r" *\t *", "\t", re.sub(r" +", " ", x)).strip() for x in "".join(p.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _zip_text(data: bytes, name: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        info = z.getinfo(name)
        if info.file_size > MAX_ENTRY:
            raise ValueError("document part too large")
        return z.read(info)


def _xml_text(data: bytes, text_tags: set[str], breaks: set[str], tabs: set[str], skip: set[str], everywhere: bool) -> str:
    """Text of an XML document, streamed: character data in text tags (or everywhere), line ends after breaks; a document type
    declaration is refused."""
    out: list[str] = []
    state = {"skip": 0, "text": 0}

    def refuse(*_):
        raise ValueError("document type declaration")

    local = lambda n: n.rpartition(":")[2]

    def start(name, _):
        n = local(name)
        state["skip"] += n in skip
        state["text"] += n in text_tags
        if n in tabs and not state["skip"]:
            out.append("\t")

    def end(name):
        n = local(name)
        state["skip"] -= n in skip
        state["text"] -= n in text_tags
        if n in breaks and not state["skip"]:
            out.append("\n")

    def chars(x):
        if not state["skip"] and (everywhere and state["text"] or state["text"]):
            out.append(x)

    p = expat.ParserCreate()
    p.StartDoctypeDeclHandler, p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = refuse, start, end, chars
    p.Parse(data, True)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def docx(data: bytes) -> str:
    """Paragraphs and rows as lines; deleted text is left out."""
    return _xml_text(_zip_text(data, "word/document.xml"), {"t"}, {"p", "tr", "br"}, {"tab", "tc"}, {"del", "delText", "moveFrom"}, False)


def odt(data: bytes) -> str:
    """Paragraphs, headings and rows as lines; tracked changes and notes of reviewers are left out."""
    return _xml_text(_zip_text(data, "content.xml"), {"p", "h"}, {"p", "h", "line-break"}, {"tab"}, {"tracked-changes", "annotation"}, True)


class TooMuch(ValueError):
    """A mail beyond the bounds, which is refused as a whole."""


def mail(data: bytes, depth: int = 0) -> list[tuple[str, str]]:
    """(section, text) of a mail: header, bodies, HTML that adds text, attachments that can be parsed, mails within. An attachment
    that cannot be read has a section "unreadable" with the reason. TooMuch for more parts, attachments or depth than allowed."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    head = "\n".join(f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if m[k])
    out = [("header", head)] if head else []
    seen: list[str] = []
    n = attachments = 0
    pages: list[str] = []
    stack = [m]
    while stack:
        part = stack.pop(0)
        n += 1
        if n > MAX_MAIL_PARTS:
            raise TooMuch("too many parts in a mail")
        kind = part.get_content_type()
        if part.is_multipart() and kind != "message/rfc822":
            stack = [*part.iter_parts(), *stack]
            continue
        name = part.get_filename()
        if kind == "message/rfc822":
            if depth >= MAX_MAIL_DEPTH:
                raise TooMuch("mails too deep within mails")
            inner = part.get_payload(0)
            out += [("attachment " + s, t) for s, t in mail(inner.as_bytes(), depth + 1)]
        elif name or part.get_content_disposition() == "attachment":
            attachments += 1
            ext = (name or "").rpartition(".")[2].lower()
            if attachments > MAX_ATTACHMENTS:
                raise TooMuch("too many attachments")
            if ext in PARSED and (body := part.get_payload(decode=True)):
                try:
                    out += [(f"attachment {name}", t) for _, t in parse(ext, body, depth + 1)]
                except TooMuch:
                    raise
                except (ValueError, KeyError, zipfile.BadZipFile, expat.ExpatError) as e:
                    out.append((f"unreadable {name}", str(e)))
        elif kind == "text/plain":
            t = part.get_content().strip()
            if t:
                seen.append(t)
                out.append(("body", t))
        elif kind == "text/html":
            pages.append(html(part.get_content()))
    squeeze = lambda x: re.sub(r"\s+", "", x.lower())
    have = squeeze("".join(seen))
    out += [("body", t) for t in pages if t and squeeze(t) not in have]
    return out


def parse(extension: str, data: bytes, depth: int = 0) -> list[tuple[str, str]]:
    """(section, text) parts of a file by its extension; ValueError for what is out of bounds or cannot be parsed."""
    if len(data) > MAX_FILE:
        raise ValueError("file too large")
    if extension in ("txt", "md", "csv", "tsv", "log"):
        parts = [("text", plain(data))]
    elif extension == "eml":
        if depth > MAX_MAIL_DEPTH:
            raise TooMuch("mails too deep within mails")
        parts = mail(data, depth)
    elif extension in ("html", "htm"):
        parts = [("text", html(data.decode("utf-8", "replace")))]
    elif extension == "docx":
        parts = [("text", docx(data))]
    elif extension == "odt":
        parts = [("text", odt(data))]
    else:
        raise ValueError(f"no parser for {extension}")
    if sum(len(t.encode()) for _, t in parts) > MAX_TEXT:
        raise ValueError("text too large")
    return [(s, t.replace("\0", "")) for s, t in parts if t.strip()]


def documents(listing: DataFrame) -> DataFrame:
    """path, ordinal, section, text, error: the parts of every file (columns path and content). A file that cannot be parsed gives
    one row with its error and no text; an empty one gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    parts = parse(path.rpartition(".")[2].lower(), data or b"")
                    out += [(path, k, s, t, None) for k, (s, t) in enumerate(parts, 1)]
                except Exception as e:  # noqa: BLE001 - any damage of a file is its row's error, not the job's
                    out.append((path, 0, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "ordinal", "section", "text", "error"])

    return listing.select("path", "content").mapInPandas(run, "path string, ordinal int, section string, text string, error string")
