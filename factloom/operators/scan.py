"""Candidates of segments, segmentation of texts, quick line rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scanner import Candidate, scan
from factloom.sources.tables import spread


def candidates(segments: DataFrame, id: str, text: str, known: tuple[str, ...] = ()) -> DataFrame:
    """id, kind, text, start, end, line, value, label, checksum of every candidate. Null and empty texts have none; segments
    repeated in id and text are scanned once. Offsets count code points from 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *c) for i, t in zip(b[id], b[text]) for c in scan(t, known)]
            o = pd.DataFrame(rows, columns=[id, *Candidate._fields])
            o["checksum"] = o["checksum"].astype("boolean")
            yield o

    kind = segments.schema[id].dataType.simpleString()
    rows = segments.select(id, text).filter(F.col(text).isNotNull()).dropDuplicates()
    return spread(rows).mapInPandas(run, f"`{id}` {kind}, kind string, text string, start int, end int, line int, value string, label string, checksum boolean")


def cut(text: str, size: int = 1600, least: int = 800, at_lines: bool = True) -> list[str]:
    """Pieces of at most size bytes, cut between characters; back to the last line end if it lies beyond least bytes."""
    raw, out, a = text.encode("utf-8", "replace"), [], 0
    while a < len(raw):
        b = min(len(raw), a + size)
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if at_lines and b < len(raw) and (n := raw.rfind(b"\n", a + least + 1, b)) >= 0:
            b = n + 1
        out.append(raw[a:b].decode())
        a = b
    return out


def segments(docs: DataFrame, id: str, text: str, size: int = 1600, at_lines: bool = True) -> DataFrame:
    """id, ordinal (from 1), text, bytes of the pieces of every text; nothing for null and empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, p, len(p.encode())) for i, t in zip(b[id], b[text]) if t for k, p in enumerate(cut(t, size, size // 2, at_lines), 1)]
            yield pd.DataFrame(rows, columns=[id, "ordinal", "text", "bytes"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).filter(F.col(text).isNotNull()).mapInPandas(run, f"`{id}` {kind}, ordinal int, text string, bytes int")


def with_titles(parts: DataFrame, titles: DataFrame, id: str) -> DataFrame:
    """Parts and, as ordinal 0, the title of every id that has one."""
    return parts.select(id, "ordinal", "text").unionByName(titles.filter("title is not null and trim(title) <> ''").select(id, F.lit(0).alias("ordinal"), F.col("title").alias("text")))


def new_lines(layer: Column, ocr: Column) -> Column:
    """Lines of an OCR text that the text layer does not hold, blanks and case aside."""
    squeeze = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    return F.filter(F.split(ocr, "\n"), lambda x: (squeeze(x) != "") & ~F.contains(squeeze(layer), squeeze(x)))


def emails(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, email: addresses by expression alone, for use without Python."""
    return docs.select(F.col(id), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"), F.lit(0))).alias("email"))


def dates(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, day, n: ISO and D.M.YYYY dates that exist, by expression alone; two-digit years are none."""
    from factloom.functions.scalars import parse_date

    found = F.regexp_extract_all(F.col(text), F.lit(r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])"), F.lit(0))
    return docs.select(F.col(id), F.explode(found).alias("d")).select(id, parse_date(F.col("d")).alias("day")).filter("day is not null").groupBy(id, "day").agg(F.count("*").alias("n"))
