"""Quantities recorded in different units, scales and recurrences, brought to common units (problem 2)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.quantities import UNITS, read
from factloom.sources.tables import checkpoint, partitions

#: Factors by which a row's amount can be off where it leaves open: minor units, groups read as decimals, recurrence.
MINOR, GROUPED, RECURRENCES = 100.0, 1000.0, (1 / 2, 1 / 4, 1 / 12, 1 / 52)
#: Tolerance of a match in log values.
MATCH = 0.006
#: Noise of log values (rounding of scaled amounts) and cost of one more segment in units of that noise squared.
NOISE, PENALTY = 0.002, 6.0
#: The best segmentation has a cut wherever two neighbours differ by more: of the two, one lies half the step or more off
#: their segment's mean, and taking it out saves a quarter of the step squared over twice the noise squared for two penalties.
CERTAIN = NOISE * math.sqrt(16 * PENALTY)

#: Time of rows without one, ahead of all others. Times go to Python as microseconds: its own span of years is shorter.
NO_TIME = -(2**63)

_READ = "value_id long, subject_id string, slot string, at long, money boolean, number double, base string, per_year double, whole boolean, grouped boolean"
_ROW = "value_id long, subject_id string, slot string, at long, x double, money boolean, base string, per_year double, whole boolean, grouped boolean"


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        cols = (b[c].where(b[c].notna(), None) for c in ("amount", "currency", "unit", "period", "context_quote"))
        for amount, currency, unit, period, context, kind in zip(*cols, b["value_type"]):
            money = kind == "money"
            r = read(amount, currency, unit, period, context, money)
            if r is None:
                out.append((money, None, None, None, False, False))
            else:
                # By the written form: '120.00' states its scale as much as '120.50'.
                out.append((money, r.value, r.base, r.per_year, money and not r.scale_stated and not r.decimals, r.ambiguous is not None))
        o = pd.DataFrame(out, columns=["money", "number", "base", "per_year", "whole", "grouped"], index=b.index)
        yield pd.concat([b[["value_id", "subject_id", "slot", "at"]], o], axis=1).astype({"number": float, "per_year": float})


def changepoints(x: np.ndarray, noise: float = NOISE, penalty: float = PENALTY) -> np.ndarray:
    """Segment number of each value: the exact optimum of squared error / (2 noise²) plus a penalty for each segment.

    Functional pruning: the least cost so far is kept as a function of the last segment's mean, in pieces that belong to one
    start each. A start whose pieces all lie above the cost of starting anew can never win again, so few remain at any length.
    """
    n = len(x)
    if x.max() == x.min():
        return np.zeros(n, dtype=np.int64)
    v = ((x - x[0]) / noise).tolist()
    start = np.zeros(n + 1, dtype=np.int64)
    # (from, to, a, b, c, start): cost a m² - 2 b m + c of mean m.
    pieces = [(min(v), max(v), 0.0, 0.0, penalty, 0)]

    def least() -> tuple[float, int]:
        return min(((a * m - 2 * b) * m + c, s) for lo, hi, a, b, c, s in pieces for m in (min(max(b / a, lo), hi),))

    for t, y in enumerate(v):
        if t:
            cost, start[t] = least()
            limit, kept = cost + penalty, []
            for lo, hi, a, b, c, s in pieces:
                root = b * b - a * (c - limit)
                r = math.sqrt(root) / a if root > 0 else 0.0
                p, q = (max(lo, b / a - r), min(hi, b / a + r)) if root > 0 else (hi, hi)
                parts = [(lo, p, 0.0, 0.0, limit, t), (p, q, a, b, c, s), (q, hi, 0.0, 0.0, limit, t)] if p < q else [(lo, hi, 0.0, 0.0, limit, t)]
                for part in parts:
                    if part[1] <= part[0]:
                        continue
                    if kept and part[5] == t == kept[-1][5]:
                        kept[-1] = (kept[-1][0], part[1], *part[2:])
                    else:
                        kept.append(part)
            pieces = kept or [(min(v), max(v), 0.0, 0.0, limit, t)]
        pieces = [(lo, hi, a + 0.5, b + 0.5 * y, c + 0.5 * y * y, s) for lo, hi, a, b, c, s in pieces]
    out, no, j = np.zeros(n, dtype=np.int64), 0, n
    start[n] = least()[1]
    while j > 0:
        i = int(start[j])
        out[i:j] = no
        j, no = i, no + 1
    return no - 1 - out


def _segments(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment number and mean of each value of pieces that begin at `starts`. A piece whose whole squared error costs less
    than one more segment is one; only the others are searched."""
    n = np.diff(np.append(starts, len(x)))
    off = x - np.repeat(np.add.reduceat(x, starts) / n, n)
    begins = np.zeros(len(x), dtype=bool)
    begins[starts] = True
    for k in np.flatnonzero(np.add.reduceat(off * off, starts) > 2 * NOISE * NOISE * PENALTY):
        i, j = starts[k], starts[k] + n[k]
        seg = changepoints(x[i:j])
        begins[i + 1 : j] = seg[1:] != seg[:-1]
    seg = np.cumsum(begins) - 1
    return seg, (np.bincount(seg, x) / np.bincount(seg))[seg]


def _levels(defer: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Segment and its mean of each row. Rows come in the order of their history; what lies between two certain cuts is
    segmented as one piece, however many batches it spans. With defer, the first and last piece of a task, which may go on in
    its neighbours, come out undone (1 for the first, 2 for the last). A piece is held in memory, about 100 bytes a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, count, pending, last, opening = TaskContext.get().partitionId(), 0, [], None, True

        def out(rows: pd.DataFrame, seg, level, undone: int) -> pd.DataFrame:
            return rows.drop(columns="piece", errors="ignore").assign(seg=seg, level=level, undone=undone, task=task)

        def done(frames: list[tuple[pd.DataFrame, np.ndarray]], at_end: bool) -> Iterator[pd.DataFrame]:
            nonlocal count, opening
            rows, starts = pd.concat([f for f, _ in frames]), np.flatnonzero(np.concatenate([c for _, c in frames]))
            if defer and opening:
                i, opening = starts[1] if len(starts) > 1 else len(rows), False
                yield out(rows.iloc[:i], 0, 0.0, 1)
                rows, starts = rows.iloc[i:], starts[1:] - i
            elif defer and at_end:
                yield out(rows, 0, 0.0, 2)
                return
            if len(rows):
                seg, level = _segments(rows["x"].to_numpy(), starts)
                number = (count + seg) + (task << 36)
                count += int(seg[-1]) + 1
                yield out(rows, number if defer else -1 - number, level, 0)

        for b in batches:
            if not len(b):
                continue
            x, key = b["x"].to_numpy(), b["subject_id"] + "\x00" + b["slot"]
            key = (key + "\x00" + b["piece"].astype(str) if "piece" in b else key).to_numpy()
            cut = np.concatenate([[last is None or key[0] != last[0] or abs(x[0] - last[1]) > CERTAIN], (key[1:] != key[:-1]) | (np.abs(np.diff(x)) > CERTAIN)])
            last, at = (key[-1], x[-1]), np.flatnonzero(cut)
            if len(at) and (pending or at[-1] > 0):
                yield from done([*pending, (b.iloc[: at[-1]], cut[: at[-1]])], False)
                pending = []
            i = at[-1] if len(at) else 0
            pending.append((b.iloc[i:], cut[i:]))
        if pending:
            yield from done(pending, True)

    return run


def _segmented(rows: DataFrame) -> DataFrame:
    """rows with seg and level. Histories stand in one order over all tasks, cut by range, so that a hot history is many tasks'
    work; the pieces at the tasks' ends are put together in a second pass. The driver gets two rows a task, to do so."""
    order = ["subject_id", "slot", "at", "value_id"]
    spark = rows.sparkSession
    schema = f"{_ROW}, seg long, level double, undone int, task int"
    once = checkpoint(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInPandas(_levels(True), schema))
    place = F.struct(*order, "x")
    ends = once.filter("undone > 0").groupBy("task", "undone").agg(F.min(place).alias("a"), F.max(place).alias("z")).collect()
    of, piece, before = [], 0, None
    for e in sorted(ends, key=lambda e: (e["task"], e["undone"])):
        a = e["a"]
        goes_on = e["undone"] == 1 and before and (before["subject_id"], before["slot"]) == (a["subject_id"], a["slot"]) and abs(before["x"] - a["x"]) <= CERTAIN
        piece, before = piece + (not goes_on), e["z"]
        of.append((e["task"], e["undone"], piece))
    pieces = F.broadcast(spark.createDataFrame(of, "task int, undone int, piece int"))
    rest = once.filter("undone > 0").join(pieces, ["task", "undone"]).select(*rows.columns, "piece")
    rest = rest.repartition(partitions(spark), "piece").sortWithinPartitions("piece", *order).mapInPandas(_levels(False), schema)
    return checkpoint(once.filter("undone = 0").unionByName(rest).drop("undone", "task"))


def _factors() -> dict[str, list[float]]:
    """What an amount without a unit may have to be divided by, for each common unit."""
    out: dict[str, set[float]] = {}
    for base, f in UNITS.values():
        out.setdefault(base, set()).add(1.0 / f)
    return {k: sorted(v) for k, v in out.items()}


def _either(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def _reversals(lev: DataFrame) -> DataFrame:
    """value_id, factor, base, periodic of rows whose segment leaves something open and lies a known factor off a stated level."""
    numbers = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    no_unit = ~F.col("money") & F.col("base").isNull()
    scale_open, no_period = F.col("whole") | F.col("grouped") | no_unit, F.col("money") & F.col("per_year").isNull()
    unit = F.when(~F.col("money"), F.col("base"))
    segs = lev.groupBy("subject_id", "slot", "seg").agg(
        F.first("level").alias("level"), F.max(~scale_open).alias("scale"), F.max(~no_period).alias("period"), F.max(F.col("per_year").isNotNull()).alias("per"), F.min(unit).alias("unit"), F.max(unit).alias("unit2")
    )
    segs = checkpoint(segs)
    history = segs.groupBy("subject_id", "slot").agg(F.max("per").alias("periodic"), F.min("unit").alias("unit"), F.max("unit2").alias("unit2"), F.max(~F.col("scale") | ~F.col("period")).alias("any"))
    history = history.filter("any").select("subject_id", "slot", "periodic", F.when(F.col("unit") == F.col("unit2"), F.col("unit")).alias("common"))
    segs = segs.drop("unit", "unit2").join(history, ["subject_id", "slot"])
    is_open = ~F.col("scale") | (F.col("periodic") & ~F.col("period"))
    cell = lambda c: F.floor(c / F.lit(MATCH))
    # Of the levels in a cell the least and greatest decide: all of the row's own cell are near, of its neighbours the nearer end.
    anchors = segs.filter(~is_open).groupBy("subject_id", "slot", cell(F.col("level")).alias("cell")).agg(F.min("level").alias("low"), F.max("level").alias("high"))
    opened = segs.filter(is_open).select("seg", "scale", "period", "periodic", "common")
    rows = lev.join(opened, "seg")
    unit_map = F.create_map(*[y for k, v in _factors().items() for y in (F.lit(k), numbers(*v))])
    by_scale = F.when(F.col("scale"), numbers(1)).when(F.col("whole") & F.col("grouped"), numbers(1, MINOR, GROUPED)).when(F.col("whole"), numbers(1, MINOR)).when(F.col("grouped"), numbers(1, GROUPED)).otherwise(numbers(1))
    by_unit = F.when(no_unit, F.coalesce(F.element_at(unit_map, F.col("common")), numbers(1))).otherwise(numbers(1))
    by_period = F.when(no_period & F.col("periodic") & ~F.col("period"), numbers(1, *RECURRENCES)).otherwise(numbers(1))
    tried = rows.withColumn("factor", F.explode(F.array_distinct(_either(_either(by_scale, by_unit), by_period)))).filter((F.col("factor") != 1.0) | no_unit)
    tried = tried.withColumn("want", F.col("level") - F.log("factor")).withColumn("cell", F.explode(F.array(*[cell(F.col("want")) + k for k in (-1, 0, 1)])))
    hit = tried.join(anchors, ["subject_id", "slot", "cell"]).filter((F.col("low") <= F.col("want") + MATCH) & (F.col("high") >= F.col("want") - MATCH))
    best = hit.groupBy("value_id").agg(F.min(F.struct(F.abs(F.log("factor")).alias("size"), "factor", F.when(no_unit, F.col("common")).alias("common"), (no_period & F.col("periodic")).alias("yearly"))).alias("b"))
    return best.select("value_id", F.col("b.factor").alias("factor"), F.col("b.common").alias("common"), F.col("b.yearly").alias("yearly"))


def common_units(values: DataFrame, rates: DataFrame) -> DataFrame:
    """value_id, subject_id, slot, recorded_at, amount_common, unit_common, reversed_factor of each money and quantity row.

    Each row is read by what it states (text beside the number, then the columns, then the context quote). Then the history
    of every subject and slot is segmented by exact penalised changepoint search on log values. A segment with a row that
    states its scale is at its true level; so a whole amount beside '120.00' stays 120. A segment whose rows all leave
    something open, and whose level lies a known factor off a stated level of the same history, is a change of unit, and its
    factor is reversed: minor units of whole amounts, 1000 where '1.234' reads both ways, the recurrence of money without one
    where other rows recur, the unit of a quantity without one (then of the history's common unit). Of several factors that
    fit the one nearest to 1 counts. Other shifts are true changes and stay.

    Exact repeats of a row count once. Rows without a readable number have a null amount; an unknown currency likewise, and a
    quantity without a unit that no level explains; rows without id are left out; null subject or slot: read, but without history. Zero and negative amounts
    are read and take no part in the search. Ties in recorded_at go by value_id, null comes first. Columns besides those named
    are ignored. rates has one row per currency (a closed list), so it is broadcast; beyond 10 000 rows it is joined by shuffle.
    """
    cols = ["value_id", "subject_id", "slot", "recorded_at", "value_type", "amount", "currency", "unit", "period", "context_quote"]
    rows = values.select(*cols).filter(F.col("value_type").isin("money", "quantity") & F.col("value_id").isNotNull()).dropDuplicates(["value_id"])
    rows = rows.withColumn("at", F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(NO_TIME))).drop("recorded_at")
    got = rows.mapInPandas(_readings, _READ)
    r = rates.select(F.col("currency").alias("base"), "eur_per_unit").dropDuplicates(["base"])
    r = F.broadcast(r) if rates.limit(10_001).count() <= 10_000 else r
    known = F.when(F.col("money"), F.col("eur_per_unit")).otherwise(1.0)
    got = got.join(r, "base", "left").withColumn("value", F.col("number") * known * F.coalesce("per_year", F.lit(1.0)))
    # Read several times below: written once, or the Python readings would run anew for each.
    got = checkpoint(got.drop("number", "eur_per_unit"))
    usable = F.coalesce((F.col("value") > 0) & F.col("subject_id").isNotNull() & F.col("slot").isNotNull(), F.lit(False))
    lev = _segmented(got.filter(usable).select("value_id", "subject_id", "slot", "at", F.log("value").alias("x"), "money", "base", "per_year", "whole", "grouped"))
    out = got.join(_reversals(lev), "value_id", "left")
    unit = F.when(~F.col("money"), F.coalesce("base", "common")).when(F.col("per_year").isNotNull() | F.coalesce("yearly", F.lit(False)), "EUR/year").otherwise("EUR")
    amount = F.when(F.col("money") | F.coalesce("base", "common").isNotNull(), F.col("value") / F.coalesce("factor", F.lit(1.0)))
    time = F.when(F.col("at") != NO_TIME, F.timestamp_micros("at")).alias("recorded_at")
    return out.select("value_id", "subject_id", "slot", time, amount.alias("amount_common"), F.when(amount.isNotNull(), unit).alias("unit_common"), F.when(F.col("factor") != 1.0, F.col("factor")).alias("reversed_factor"))


def near_pairs(common: DataFrame, share: float = 0.005) -> DataFrame:
    """value_id_a, value_id_b (smaller first): rows of one subject and slot whose common amounts differ by at most a share
    of the greater. An equi-join on cells of the logarithm, each row meeting its own and the next cell; no pair twice.
    Null amounts, subjects and slots take no part; zero equals zero only; signs never mix."""
    width = -math.log1p(-share)
    v = common.filter("amount_common is not null and subject_id is not null and slot is not null").select("value_id", "subject_id", "slot", "amount_common", "unit_common")
    a = F.abs("amount_common")
    v = v.withColumn("side", F.signum("amount_common").cast("int")).withColumn("cell", F.when(a > 0, F.floor(F.log(a) / width)).otherwise(0))
    left = v.select("subject_id", "slot", "side", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"), F.col("value_id").alias("l"), F.col("amount_common").alias("x"), F.col("cell").alias("own"))
    right = v.select("subject_id", "slot", "side", "cell", F.col("value_id").alias("r"), F.col("amount_common").alias("y"))
    met = left.join(right, ["subject_id", "slot", "side", "cell"]).filter((F.col("own") != F.col("cell")) | (F.col("l") < F.col("r")))
    met = met.filter((F.col("side") != 0) | (F.col("own") == F.col("cell"))).filter("l <> r")
    met = met.filter(F.abs(F.col("x") - F.col("y")) <= share * F.greatest(F.abs("x"), F.abs("y")) * (1 + 1e-9))
    return met.select(F.least("l", "r").alias("value_id_a"), F.greatest("l", "r").alias("value_id_b"))
