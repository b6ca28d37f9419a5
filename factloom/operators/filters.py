"""Predicates and projections on sources, facts and validity (filters F1 to F15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a caller's input: bytes of a query, fields, rows asked for, ids to review.
MAX_QUERY_BYTES, MAX_FIELDS, MAX_LIMIT, MAX_REVIEW_IDS = 4096, 16, 30, 1024


def visible(sensitivity: Column, retention: Column) -> Column:
    """Personal and kept; null counts as not visible."""
    return F.coalesce((sensitivity == "personal") & (retention == "keep"), F.lit(False))


def effective(kind: Column, start: Column, end: Column, day: Column) -> Column:
    """Whether a validity holds on a day: unknown and timeless always, a point on its day, an interval from its start until
    before its end (open without one). Null kind or day: no."""
    inside = (start <= day) & (end.isNull() | (day < end))
    return F.coalesce(F.when(kind.isin("unknown", "timeless"), True).when(kind == "point", start == day).when(kind == "interval", inside).otherwise(False), F.lit(False)) & day.isNotNull()


def scoped(rows: DataFrame, ids: DataFrame, key: str, bound: int = 100_000) -> DataFrame:
    """Rows whose key is in a list of ids; the list is broadcast only where it has at most so many ids."""
    ids = ids.select(key).distinct()
    return rows.join(F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids, key, "left_semi")


def check_request(query: str = "", fields: int = 1, limit: int = 1, review_ids: int = 0) -> None:
    """Raises ValueError if a request is out of bounds."""
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise ValueError(f"query longer than {MAX_QUERY_BYTES} bytes")
    if not 1 <= fields <= MAX_FIELDS:
        raise ValueError(f"1 to {MAX_FIELDS} fields")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit from 1 to {MAX_LIMIT}")
    if review_ids > MAX_REVIEW_IDS:
        raise ValueError(f"at most {MAX_REVIEW_IDS} ids")


def display_money(amount: Column, currency: Column, period: Column) -> Column:
    """amount code per period, without what is null; null without an amount."""
    return F.when(amount.isNotNull(), F.concat_ws(" ", amount, currency, F.when(period.isNotNull(), F.concat(F.lit("per "), period))))


def location(page: Column, section: Column, method: Column) -> Column:
    """Where in its source a text stands: page, else section, else Source; with a mark for text read by OCR."""
    place = F.coalesce(F.concat(F.lit("Page "), page.cast("int").cast("string")), section, F.lit("Source"))
    return F.concat(place, F.when(F.lower(F.coalesce(method, F.lit(""))) == "ocr", " (OCR)").otherwise(""))


def compact(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def matches_words(query: str, label: Column, value: Column, stop: tuple[str, ...] = ("the", "a", "my", "der", "die", "das", "mein", "meine", "of", "for")) -> Column:
    """Whether every word of the query but stop words stands in the label or the value; an empty query matches nothing."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if w not in stop]
    if not words:
        return F.lit(False)
    a, b = compact(F.coalesce(label, F.lit(""))), compact(F.coalesce(value, F.lit("")))
    return F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(a, w) | F.contains(b, w))


def catalog(facts: DataFrame, key: str = "property", label: str = "label", order: str = "fact_id") -> DataFrame:
    """key, label: every key once with the label of its last row in order; null keys are left out."""
    return facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(label, order).alias(label))
