"""Grounding, typing, coverage and verification of extracted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of verdicts and classification.
REJECT_FAILURE, REJECT_CONFIDENCE = 0.7, 0.6
FAMILY, TYPE, READABLE, MIXED, SUBJECT = 0.5, 0.8, 0.35, 0.7, 0.6


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def grounded(quote: Column, text: Column) -> Column:
    """exact where the text holds the quote as whole words, spaced where it does so up to white space, else null.

    Whole words: no letter or digit next to it, no digit mark that would split a number, no lost sign before a digit."""
    esc = lambda x: F.regexp_replace(x, r"([\\\[\]{}()*+?.^$|])", r"\\$1")
    whole = lambda q, t: (F.length(q) > 0) & F.contains(t, q) & F.regexp_like(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<![0-9][.,])(?<!-(?=[0-9]))"), esc(q), F.lit(r"(?![\p{L}\p{N}])(?![.,][0-9])")))

    def first(q: Column, t: Column) -> Column:
        """The same for the quote's first place alone, without a pattern for each row."""
        at = F.instr(t, q)
        before, after = F.substring(t, F.greatest(at - 2, F.lit(1)), F.least(at - 1, F.lit(2))), F.substring(t, at + F.length(q), 2)
        split = before.rlike(r"[\p{L}\p{N}]$|[0-9][.,]$") | (F.endswith(before, F.lit("-")) & q.rlike("^[0-9]"))
        return (F.length(q) > 0) & (at > 0) & ~split & ~after.rlike(r"^[\p{L}\p{N}]|^[.,][0-9]")

    fits = lambda q, t: first(q, t) | whole(q, t)
    return F.when(fits(quote, text), "exact").when(fits(squeeze(quote), squeeze(text)), "spaced")


def ground(facts: DataFrame, segments: DataFrame) -> DataFrame:
    """fact_id, code: ok, or the first reason against a fact: no_value, no_segment, quote_missing, value_missing, subject_missing.

    The quote must stand in its segment, the value in the quote, the subject (if any) somewhere in the segment; up to white
    space. Facts join their segment on its id only. Facts repeated in fact_id count once."""
    s = segments.select("segment_id", "text").filter("segment_id is not null").dropDuplicates(["segment_id"])
    f = facts.select("fact_id", "segment_id", "value", "quote", "subject_quote").dropDuplicates(["fact_id"]).join(s, "segment_id", "left")
    inside = lambda a, b: F.contains(squeeze(F.lower(b)), squeeze(F.lower(a)))
    code = F.when(F.col("value").isNull() | (F.trim("value") == "") | F.col("quote").isNull(), "no_value").when(F.col("text").isNull(), "no_segment")
    code = code.when(~inside(F.col("quote"), F.col("text")), "quote_missing").when(~inside(F.col("value"), F.col("quote")), "value_missing")
    code = code.when(F.col("subject_quote").isNotNull() & (F.trim("subject_quote") != "") & ~inside(F.col("subject_quote"), F.col("text")), "subject_missing").otherwise("ok")
    return f.select("fact_id", code.alias("code"))


def merge_same(facts: DataFrame) -> DataFrame:
    """One row per source, property, normalised value and subject: its least fact_id, number of rows, first slot and longest context."""
    norm = lambda c: F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]", ""))
    f = facts.dropDuplicates(["fact_id"]).withColumns({"_v": norm("value"), "_s": norm("subject_quote")}).filter("_v is not null")
    g = f.groupBy("source_id", "property", "_v", "_s").agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("n"), F.min(F.when(F.coalesce(F.trim("slot"), F.lit("")) != "", F.struct("fact_id", "slot"))).alias("sl"), F.max(F.struct(F.length("context_quote").alias("l"), "context_quote")).alias("cx"))
    return g.select("source_id", "property", "fact_id", "n", F.col("sl.slot").alias("slot"), F.col("cx.context_quote").alias("context_quote"))


def locate(part: Column, whole: Column) -> Column:
    """Start (from 0) and end of a part in a text, null if it is not there verbatim."""
    at = F.instr(whole, part)
    return F.when((at > 0) & (F.length(part) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(part)).alias("end")))


def document_currency(values: DataFrame, key: str = "source_id", currency: str = "currency") -> DataFrame:
    """key, currency: the one currency of a document, where there is just one."""
    g = values.filter(F.col(currency).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(currency).alias("_lo"), F.max(currency).alias("_hi"))
    return g.filter("_lo = _hi").select(key, F.col("_lo").alias(currency))


def band(failure: Column, confidence: Column, threshold: Column) -> Column:
    """reject, check or accept; a null counts as the worst."""
    f, c = F.coalesce(failure, F.lit(1.0)), F.coalesce(confidence, F.lit(0.0))
    return F.when((f > REJECT_FAILURE) | (c < REJECT_CONFIDENCE), "reject").when(c < threshold, "check").otherwise("accept")


def combine(*heads: Column, failure: Column) -> Column:
    """Confidence of a verdict: its weakest answered head, at most one minus the failure."""
    return F.least(1 - failure, *heads)


def contested(values: DataFrame, keys: list[str], id: str, confidence: str = "confidence", floor: float = 0.6, most: int = 60) -> DataFrame:
    """id, winner, confidence, n: of several values for one slot the most confident of the first `most` (by id) wins if it
    reaches the floor; all others are unmapped, possibly all. Rows with a null key are left out. The first `most` are the bound of the feature."""
    v = values.select(*keys, id, confidence)
    n = v.groupBy(*keys).agg(F.count("*").alias("n"))
    # Ranks up to a bound are cut ahead of the shuffle, so a hot slot is no large task.
    few = v.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(id))).filter(F.col("_n") <= most)
    top = few.groupBy(*keys).agg(F.max_by(F.struct(F.col(id).alias("i"), F.col(confidence).alias("c")), F.struct(F.coalesce(F.col(confidence), F.lit(-1.0)), -F.col(id))).alias("t"))
    v = v.join(n, keys)
    r = v.join(top, keys)
    return r.select(id, ((F.col("t.i") == F.col(id)) & F.coalesce(F.col("t.c") >= floor, F.lit(False))).alias("winner"), F.col(confidence).alias("confidence"), "n")


def uncovered(candidates: DataFrame, spans: DataFrame, key: str = "segment_id") -> DataFrame:
    """Candidates (key, start, end) whose span lies inside no covered span of its segment; a segment's spans are few, so the
    join on the segment stays near the size of the candidates."""
    a, b = candidates.alias("a"), spans.select(key, "start", "end").distinct().alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end")), "left_anti")


def refund_sign(amount: Column, direction: Column) -> Column:
    """Refunds negative, payments positive, zero without sign."""
    return F.when(amount == 0, F.lit(0.0)).when(direction == "refund", -F.abs(amount)).when(direction == "payment", F.abs(amount)).otherwise(amount)


def fact_state(verdict: Column, verified: Column, mapped: Column) -> Column:
    """verified, uncertain, unverified or uninterpreted."""
    return F.when(~verified, "unverified").when(~mapped, "uninterpreted").when(verdict == "accept", "verified").otherwise("uncertain")


def classify(family: Column, family_confidence: Column, doc_type: Column, type_confidence: Column, readable: Column, mixed: Column, subject: Column, subject_confidence: Column) -> Column:
    """Struct (family, doc_type, subject): an unsure family becomes other and has no type; a type needs a readable document of one
    kind; a subject needs its confidence. Nulls count as unsure."""
    sure = lambda c, x: F.coalesce(c >= x, F.lit(False))
    fam = F.when(sure(family_confidence, FAMILY) & family.isNotNull(), family).otherwise("other")
    typed = (fam != "other") & sure(type_confidence, TYPE) & sure(readable, READABLE) & F.coalesce(mixed < MIXED, F.lit(False))
    return F.struct(fam.alias("family"), F.when(typed, doc_type).alias("doc_type"), F.when(sure(subject_confidence, SUBJECT) & (F.trim(subject) != ""), subject).alias("subject"))


def first_by_priority(*rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of several tables, for each key those of the first table that has it, there the least in order."""
    every = None
    for k, r in enumerate(rows):
        r = r.withColumn("priority", F.lit(k))
        every = r if every is None else every.unionByName(r)
    w = Window.partitionBy(*keys).orderBy("priority", order)
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
