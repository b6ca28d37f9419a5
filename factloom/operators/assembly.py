"""Assembly of facts: writes with checks, typing, entity resolution, batches, review and retrieval contexts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalars


def checked_writes(rows: DataFrame, properties: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows with key and verdict: ok, unknown_property, wrong_type, no_value, repeated (in the batch) or existing.

    The key is a hash of subject, property, normalised value and start; the least value_id of a key is the one written. Properties
    are few and broadcast up to 10 000, else joined by shuffle."""
    p = properties.select("slot", F.col("value_type").alias("_type")).dropDuplicates(["slot"])
    p = F.broadcast(p) if properties.limit(10_001).count() <= 10_000 else p
    value = F.trim(F.regexp_replace("value", r"\s+", " "))
    r = rows.join(p, "slot", "left").withColumn("key", scalars.semantic_key(F.col("subject_id"), F.col("slot"), value, F.col("valid_from")))
    first = r.groupBy("key").agg(F.min("value_id").alias("_first"))
    r = r.join(first, "key")
    verdict = F.when(F.col("_type").isNull(), "unknown_property").when(F.col("_type") != F.col("value_type"), "wrong_type").when(value.isNull() | (value == ""), "no_value").when(F.col("_first") != F.col("value_id"), "repeated")
    if existing is not None:
        r = r.join(existing.select("key", F.lit(True).alias("_there")).distinct(), "key", "left")
        verdict = verdict.when(F.col("_there"), "existing")
    return r.select("value_id", "key", verdict.otherwise("ok").alias("verdict"))


def typed(kind: Column, value: Column) -> Column:
    """A value in the form of its slot's kind, null if it does not fit: a date as ISO, an identifier in capitals, a decimal in its one
    form, a text with single blanks."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(kind == "date", scalars.parse_date(F.trim(value)).cast("string")).when(kind == "identifier", F.nullif(scalars.normalize_identifier(value), F.lit(""))).when(kind == "money", scalars.canonical_decimal(F.trim(value))).when((text != "") & (F.length(text) <= 4000), text)


def looks_like_money(value: Column) -> Column:
    """A number with a currency next to it."""
    return F.coalesce(value.rlike(r"[0-9]\s?(?:€|EUR|Euro|\$|USD|£|GBP|CHF|Fr\.|zł|Kč|DM)|(?:€|EUR|US\$|£|Fr\.|zł|Kč|DM)\s?[0-9]"), F.lit(False))


def valid_answer(probabilities: Column, chosen: Column) -> Column:
    """Whether an answer's probabilities lie in 0 to 1, sum to 1 within 0.01, and the chosen one (from 1) is the greatest."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    fine = F.forall(probabilities, lambda x: (x >= 0) & (x <= 1)) & (F.abs(total - 1) <= 0.01) & (F.element_at(probabilities, chosen) == F.array_max(probabilities))
    return F.coalesce(fine, F.lit(False))


def batches(rows: DataFrame, id: str, group: str, text: str, most: int = 40, size: int = 20_000, salts: int = 1) -> DataFrame:
    """group, id, batch (from 0), bytes: greedy batches of at most `most` rows and `size` bytes in order of id; one row at least, however
    long. A group streams in constant memory through as many tasks as there are salts; batch numbers are then batch * salts + salt."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, k, used, held = None, 0, 0, 0
        for b in it:
            out = []
            for g, salt, length in zip(b[group], b["_salt"], b["bytes"]):
                if (g, salt) != now:
                    now, k, used, held = (g, salt), 0, 0, 0
                elif held and (held >= most or used + length > size):
                    k, used, held = k + 1, 0, 0
                used, held = used + length, held + 1
                out.append(k * salts + salt)
            yield b.assign(batch=out)[[group, id, "batch", "bytes"]]

    r = rows.select(group, id, F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("bytes"), F.pmod(F.xxhash64(id), F.lit(salts)).cast("int").alias("_salt")).filter(F.col(group).isNotNull())
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return r.repartition(n, group, "_salt").sortWithinPartitions(group, "_salt", id).mapInPandas(run, f"`{group}` {kind(group)}, `{id}` {kind(id)}, batch int, bytes long")


def sections(rows: DataFrame, id: str, group: str, text: str, size: int = 12_000) -> DataFrame:
    """group, section, id: batches of a byte size whose last row opens the next section again, so that nothing is cut apart."""
    b = batches(rows, id, group, text, most=1 << 30, size=size)
    last = b.groupBy(group, "batch").agg(F.max(id).alias(id), F.count("*").alias("_n"))
    tops = b.groupBy(group).agg(F.max("batch").alias("_top"))
    again = last.join(tops, group).filter("batch < _top and _n > 1").select(group, (F.col("batch") + 1).alias("section"), id)
    return b.select(group, F.col("batch").alias("section"), id).unionByName(again)


def current(rows: DataFrame, id: str = "id", supersedes: str = "supersedes", accepted: str = "accepted") -> DataFrame:
    """id, current: an accepted row itself, else the least accepted row that supersedes it, else null."""
    s = rows.filter(F.col(accepted) & F.col(supersedes).isNotNull()).groupBy(supersedes).agg(F.min(id).alias("_by")).withColumnRenamed(supersedes, "_old")
    return rows.join(s, F.col(id) == F.col("_old"), "left").select(id, F.when(F.col(accepted), F.col(id)).otherwise(F.col("_by")).alias("current"))


def equivalents(rows: DataFrame, keys: list[str], value: str, id: str) -> DataFrame:
    """id, keep: rows of one key whose compacted values agree point to the least id, which takes their evidence."""
    norm = F.regexp_replace(F.lower(F.col(value)), r"[^\p{L}\p{N}]", "")
    r = rows.select(id, *keys, norm.alias("_v")).filter("_v is not null and _v <> ''")
    first = r.groupBy(*keys, "_v").agg(F.min(id).alias("keep"))
    return r.join(first, [*keys, "_v"]).select(id, "keep")


def disagreeing(rows: DataFrame, keys: list[str], value: str, id: str) -> DataFrame:
    """keys, n_values, first, other: groups with several values, with the least row of the least and of the greatest value as the
    pair to judge; not all pairs."""
    g = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.min(F.struct(F.col(value).alias("v"), F.col(id).alias("i"))).alias("a"), F.max(F.struct(F.col(value).alias("v"), (-F.col(id)).alias("i"))).alias("b"))
    return g.filter("n_values > 1").select(*keys, "n_values", F.col("a.i").alias("first"), (-F.col("b.i")).alias("other"))


def retrieval(hits: DataFrame, per_query: int = 6, per_source: int = 12, most: int = 36) -> DataFrame:
    """segment_id, source_id, query_no, rank, place: each segment once by its first query, at most per_query a query, per_source a source
    and `most` in all. The bounds are the feature."""
    w = lambda *p: Window.partitionBy(*p)
    h = hits.filter(F.col("rank") <= per_query)
    h = h.withColumn("_n", F.row_number().over(w("segment_id").orderBy("query_no", "rank"))).filter("_n = 1")
    h = h.withColumn("_s", F.row_number().over(w("source_id").orderBy("query_no", "rank", "segment_id"))).filter(F.col("_s") <= per_source)
    h = h.orderBy("query_no", "rank", "segment_id").limit(most)
    return h.withColumn("place", F.row_number().over(Window.orderBy("query_no", "rank", "segment_id"))).drop("_n", "_s")


def page(rows: DataFrame, order: list[Column], size: int) -> tuple[DataFrame, bool]:
    """The first rows in order and whether there are more."""
    more = rows.orderBy(*order).limit(size + 1)
    return rows.orderBy(*order).limit(size), more.count() > size
