"""Intake, budgets, progress, change capture, login versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intake(items: DataFrame, id: str, content: Column, known: DataFrame | None = None) -> DataFrame:
    """id, fingerprint, duplicate_of: content-addressed intake. The least id of a fingerprint is stored, others point to it; a
    fingerprint that is known already points to its known id. Null contents have no fingerprint and are never duplicates.
    The stored id comes by aggregation, so one text with a third of all rows is no single task."""
    rows = items.select(F.col(id).alias("id"), F.sha2(content.cast("binary"), 256).alias("fingerprint"))
    first = rows.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("id").alias("_first"))
    if known is not None:
        first = first.join(known.groupBy("fingerprint").agg(F.min("known_id").alias("_known")), "fingerprint", "left").withColumn("_first", F.coalesce("_known", "_first")).drop("_known")
    out = rows.join(first, "fingerprint", "left")
    return out.select("id", "fingerprint", F.when(F.col("_first") != F.col("id"), F.col("_first")).alias("duplicate_of"))


def deliveries(items: DataFrame, connector: str, key: str, order: str) -> DataFrame:
    """The first delivery of every connector and key; rows without either stay all."""
    has = F.col(connector).isNotNull() & F.col(key).isNotNull()
    first = items.filter(has).groupBy(connector, key).agg(F.min_by(F.struct(*[F.col(c) for c in items.columns if c not in (connector, key)]), order).alias("_r"))
    rest = [F.col(f"_r.{c}").alias(c) if c not in (connector, key) else F.col(c) for c in items.columns]
    return first.select(*rest).unionByName(items.filter(~has))


def export(changes: DataFrame, after: int, rows: int = 100, size: int = 8_000_000, payload: str = "payload", seq: str = "seq") -> DataFrame:
    """The next batch after a cursor: at most so many rows and bytes, but one row at least, which may be larger than that."""
    w = Window.orderBy(seq)
    page = changes.filter(F.col(seq) > after).orderBy(seq).limit(rows)
    page = page.withColumns({"_n": F.row_number().over(w), "_b": F.sum(F.octet_length(F.coalesce(F.col(payload), F.lit("")))).over(w)})
    return page.filter((F.col("_n") == 1) | (F.col("_b") <= size)).drop("_n", "_b")


def reserve(requests: DataFrame, key: str, order: str, tokens: str, calls: int, budget: int) -> DataFrame:
    """Requests with granted: in order, those within the limits of calls and tokens of their key. Refused requests use nothing of
    either, so replay is sequential per key; a key's requests stream through one task in constant memory."""
    cols = [c for c in requests.columns if c != "granted"]
    fields = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in cols)
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, left = None, 0, budget
        for b in batches:
            out = []
            for k, t in zip(b[key], b[tokens]):
                if k != now:
                    now, used, left = k, 0, budget
                t = 0 if t is None or t != t else int(t)
                ok = used < calls and t <= left
                used, left = used + ok, left - t * ok
                out.append(ok)
            yield b.assign(granted=out)

    return requests.select(*cols).repartition(n, key).sortWithinPartitions(key, order).mapInPandas(run, f"{fields}, granted boolean")


def usage(requests: DataFrame, key: str, tokens: str, least_calls: int = 12, least_tokens: int = 180_000) -> DataFrame:
    """key, calls, tokens, unreported, limits never below the defaults."""
    g = requests.groupBy(key).agg(F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count_if(F.col(tokens).isNull()).alias("unreported"))
    return g.withColumns({"call_limit": F.greatest(F.lit(least_calls), F.col("calls")), "token_limit": F.greatest(F.lit(least_tokens).cast("long"), F.col("tokens").cast("long"))})


def journal(before: DataFrame, after: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """id, operation (insert, update, delete), payload: what changed between two snapshots, by hashes of the columns; one row per id."""
    h = lambda d, n: d.dropDuplicates([id]).select(F.col(id), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias(f"_h{n}"), F.to_json(F.struct(*columns)).alias(f"_p{n}"))
    j = h(before, 0).join(h(after, 1), id, "full").filter(~F.col("_h0").eqNullSafe(F.col("_h1")))
    op = F.when(F.col("_h0").isNull(), "insert").when(F.col("_h1").isNull(), "delete").otherwise("update")
    return j.select(id, op.alias("operation"), F.coalesce("_p1", "_p0").alias("payload"))


def causal(changes: DataFrame, record: list[str], seq: str) -> DataFrame:
    """Changes with parent: the change before of the same record."""
    return changes.withColumn("parent", F.lag(seq).over(Window.partitionBy(*record).orderBy(seq)))


def versions(logins: DataFrame, keys: list[str], id: str) -> DataFrame:
    """Logins with versions (how many of one place and user) and version (from 1, by id)."""
    w = Window.partitionBy(*keys)
    return logins.withColumns({"n_versions": F.count("*").over(w), "n_version": F.row_number().over(w.orderBy(id))})


def claims(items: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The next items of a queue by priority; the number is the feature."""
    return items.orderBy(*order).limit(n)


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items not done yet under the same keys (content, stage, version): null-safe, so a null content is done once."""
    on = None
    for k in keys:
        c = F.col(f"i.{k}").eqNullSafe(F.col(f"d.{k}"))
        on = c if on is None else on & c
    return items.alias("i").join(done.select(*keys).distinct().alias("d"), on, "left_anti")
