"""The four read-only questions that a client may ask of a store's tables (S17), as functions that give DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import search, timeline
from factloom.plans.facts import closed
from factloom.sources.tables import table


def find(spark: SparkSession, d: str, query: str, limit: int = 30) -> DataFrame:
    """id, rank, more, excerpt of the documents that hold the words of a query. ValueError for one out of bounds."""
    docs = table(spark, d, "documents")
    return search.excerpts(search.search(search.index_of(docs, "doc_id", "text", d), query, limit), docs, "doc_id", "text", query).orderBy("rank")


def entities(spark: SparkSession, d: str, vault: str) -> DataFrame:
    """entity_id, kind, label of a vault's entities that are not deleted; none for an unknown vault."""
    e = table(spark, d, "entities").filter((F.col("vault") == vault) & F.col("deleted_at").isNull())
    return e.select("entity_id", "kind", "label").dropDuplicates(["entity_id"]).orderBy("entity_id")


def facts(spark: SparkSession, d: str, subject_id: str, day: str) -> DataFrame:
    """slot, status, n_values, value of a subject at a day (YYYY-MM-DD)."""
    rows = closed(spark, d).filter(F.col("subject_id") == subject_id).withColumn("kind", F.lit("interval"))
    return timeline.resolve(rows, ["slot"], F.lit(day).cast("date")).orderBy("slot")


def source(spark: SparkSession, d: str, source_id: str) -> DataFrame:
    """ordinal, page, section, text of a source's parts in order, each once."""
    p = table(spark, d, "parts").filter(F.col("source_id") == source_id)
    return p.select("segment_id", "ordinal", "page", "section", "text").dropDuplicates(["segment_id"]).orderBy("ordinal", "segment_id").drop("segment_id")


TOOLS: dict[str, Callable[..., DataFrame]] = {"find": find, "entities": entities, "facts": facts, "source": source}
