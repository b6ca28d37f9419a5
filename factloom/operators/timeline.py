"""Timelines of single-valued facts: closing, conflicts, supersession, withdrawal, reading at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(assertions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Assertions with state and actor of their latest decision (greatest seq), proposed without one."""
    last = decisions.groupBy("assertion_id").agg(F.max_by(F.struct("action", "actor"), "seq").alias("d"))
    return assertions.join(last, "assertion_id", "left").withColumns({"state": F.coalesce("d.action", F.lit("proposed")), "actor": F.col("d.actor")}).drop("d")


def retimeline(rows: DataFrame, keys: list[str], start: str = "valid_from", value: str = "value", end: str = "valid_to") -> DataFrame:
    """Rows with an end: an open interval closes at the least later start with a different value.

    Equal values do not close; values with the same start do not close each other; an end that is given stays. Starts are first
    brought to one row per key and start (days, so few even for a key with a third of all rows); one window, read from the last
    start to the first, then finds the next start and where the next start's run of one value ends. Null starts or values stay
    open. Order of rows does not matter.
    """
    ok = F.col(start).isNotNull() & F.col(value).isNotNull()
    starts = rows.filter(ok).groupBy(*keys, start).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    back = Window.partitionBy(*keys).orderBy(F.desc(start))
    starts = starts.withColumn("_one", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))
    starts = starts.withColumns({"_next": F.lag(start).over(back), "_next_one": F.lag("_one").over(back)})
    # Where a run of one value ends, the start after it is what closes the run; it is carried down to the run's first start.
    edge = F.when(~(F.col("_next_one").eqNullSafe(F.col("_one")) & F.col("_one").isNotNull()), F.struct(F.col("_next").alias("at")))
    starts = starts.withColumn("_out", F.last(edge, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    starts = starts.withColumn("_after", F.lag("_out.at").over(back))
    joined = rows.join(starts.select(*keys, start, "_next", "_next_one", "_after"), [*keys, start], "left")
    close = F.when(F.col("_next_one").eqNullSafe(F.col(value)), F.col("_after")).otherwise(F.col("_next"))
    given = F.col(end) if end in rows.columns else F.lit(None).cast(rows.schema[start].dataType)
    return joined.withColumn(end, F.coalesce(given, F.when(ok, close))).drop("_next", "_next_one", "_after")


def conflicts(rows: DataFrame, keys: list[str], id: str, start: str = "valid_from", end: str = "valid_to", value: str = "value") -> DataFrame:
    """Ids of rows that overlap another of their keys with a different value; null-safe on the keys, an unknown start or end is open.

    A sweep over the points of the distinct intervals, no pairs: an interval meets as many as begin before its end less those
    that end by its start. Counted among all values and among its own; where these differ, it meets another value. The windows
    keep running counts only, so a key with very many intervals takes sorting, not squares. Intervals that end by their start
    (only where the rows say so) do not fit the count and meet the others in a join of their own.
    """
    place = lambda c, unknown: F.struct(F.when(F.col(c).isNull(), unknown).otherwise(1).alias("f"), F.col(c).alias("v"))
    cols = [*keys, "_v", "_a", "_z"]
    own = rows.withColumns({"_v": F.col(value), "_a": place(start, 0), "_z": place(end, 2)})
    spans = own.filter("_v is not null").select(*cols).distinct()
    proper, odd = spans.filter("_a < _z"), spans.filter("not (_a < _z)")
    # At one place ends come ahead of starts: who ends there is past, who begins there is not yet met.
    points = proper.select("*", F.explode(F.array(F.struct(F.col("_a").alias("at"), F.lit(True).alias("begins")), F.struct(F.col("_z").alias("at"), F.lit(False).alias("begins")))).alias("_p"))
    count = lambda by: {True: F.sum((~F.col("_p.begins")).cast("long")).over(by), False: F.sum(F.col("_p.begins").cast("long")).over(by)}
    over = lambda *by: Window.partitionBy(*by).orderBy("_p.at", "_p.begins").rowsBetween(Window.unboundedPreceding, 0)
    every, same = count(over(*keys)), count(over(*keys, "_v"))
    seen = points.withColumn("_same", F.when(F.col("_p.begins"), same[True]).otherwise(same[False])).withColumn("_all", F.when(F.col("_p.begins"), every[True]).otherwise(every[False]))
    other = F.sum((F.col("_all") - F.col("_same")) * F.when(F.col("_p.begins"), -1).otherwise(1)).alias("_n")
    hit = seen.groupBy(*cols).agg(other).filter("_n > 0").select(*cols)
    safe = lambda x, y, names: F.lit(True) if not names else safe(x, y, names[1:]) & F.col(f"{x}.{names[0]}").eqNullSafe(F.col(f"{y}.{names[0]}"))
    meets = safe("a", "b", keys) & (F.col("a._v") != F.col("b._v")) & (F.col("a._a") < F.col("b._z")) & (F.col("b._a") < F.col("a._z"))
    hit = hit.unionByName(spans.alias("a").join(odd.alias("b"), meets, "left_semi")).unionByName(odd.alias("a").join(proper.alias("b"), meets, "left_semi")).distinct()
    return own.alias("r").join(hit.alias("h"), safe("r", "h", cols), "left_semi").select(id)


def resolve(rows: DataFrame, keys: list[str], day: Column, many: bool = False, value: str = "value", kind: str = "kind", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """keys, status, n_values, value at a day: missing, conflict (a single-valued fact with several values), uncertain (a
    value of unknown validity), multiple, resolved. Every key of the rows comes out; value only where one is left."""
    from factloom.operators.filters import effective

    on = effective(F.col(kind), F.col(start), F.col(end), day) & F.col(value).isNotNull()
    g = rows.withColumn("_v", F.when(on, F.col(value))).withColumn("_u", on & (F.col(kind) == "unknown"))
    # The least and the greatest tell one value from several without holding them all.
    g = g.groupBy(*keys).agg(F.count_distinct("_v").alias("n_values"), F.max("_u").alias("_u"), F.min("_v").alias("_lo"))
    status = F.when(F.col("n_values") == 0, "missing").when((F.col("n_values") > 1) & F.lit(not many), "conflict").when(F.col("_u"), "uncertain").when(F.col("n_values") > 1, "multiple").otherwise("resolved")
    return g.select(*keys, status.alias("status"), "n_values", F.when(F.col("n_values") == 1, F.col("_lo")).alias("value"))


def superseded(rows: DataFrame, corrections: DataFrame, keys: list[str], id: str, source: str = "source_id") -> DataFrame:
    """Ids of automatic rows that a correction of another source with the same keys replaces (null-safe keys)."""
    c = corrections.select(*keys, source).groupBy(*keys).agg(F.min(source).alias("_lo"), F.max(source).alias("_hi"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    cond = cond & (F.col(f"r.{source}").isNull() | (F.col("c._lo") != F.col(f"r.{source}")) | (F.col("c._hi") != F.col(f"r.{source}")))
    return rows.filter("not user_decided").alias("r").join(c.alias("c"), cond, "left_semi").select(id)


def withdrawn(evidence: DataFrame, stated: DataFrame, id: str = "assertion_id", source: str = "source_id") -> DataFrame:
    """id, source, action: evidence a source no longer states; 'retract' if no other source holds the assertion, else 'unlink'."""
    others = evidence.groupBy(id).agg(F.count_distinct(source).alias("_n"))
    gone = evidence.select(id, source).distinct().join(stated.select(id, source).distinct(), [id, source], "left_anti")
    return gone.join(others, id).select(id, source, F.when(F.col("_n") > 1, "unlink").otherwise("retract").alias("action"))


def threshold(outcomes: DataFrame, last: int = 50, sure: float = 0.8, least: int = 20) -> DataFrame:
    """n, corrected, threshold: of the last outcomes with a sure confidence; 0.8 for few of them, 0.9 if more than a tenth was
    corrected, 0.7 if none was, else 0.8. The newest count (recorded_at, then outcome_id); the limit is the feature."""
    recent = outcomes.filter(F.col("confidence") >= sure).orderBy(F.desc("recorded_at"), F.desc("outcome_id")).limit(last)
    g = recent.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("corrected").cast("int")), F.lit(0)).alias("corrected"))
    return g.withColumn("threshold", F.when(F.col("n") < least, 0.8).when(F.col("corrected") * 10 > F.col("n"), 0.9).when(F.col("corrected") == 0, 0.7).otherwise(0.8))


def review_state(actor: Column, reason: Column) -> Column:
    """reviewed after a user's decision, check where the policy left a reason, else unreviewed."""
    return F.when(actor == "user", "reviewed").when((actor == "policy") & reason.isNotNull(), "check").otherwise("unreviewed")


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def validity(kind: Column, start: Column, end: Column, document_date: Column) -> Column:
    """Struct (kind, valid_from, valid_to) by rule: timeless; a document's inclusive period to a half-open interval; open from
    a date, else from the document's date; unknown where neither is known."""
    none = F.lit(None).cast("date")
    v = lambda k, a, b: F.struct(F.lit(k).alias("kind"), a.alias("valid_from"), b.alias("valid_to"))
    begin = F.coalesce(start, document_date)
    return F.when(kind == "timeless", v("timeless", none, none)).when((kind == "period") & start.isNotNull(), v("interval", start, next_day(end))).when((kind == "open") & begin.isNotNull(), v("interval", begin, none)).otherwise(v("unknown", none, none))
