import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest

from factloom.functions.quantities import has_decimals, number, read, recurrence
from factloom.operators import units

SCHEMA = "value_id long, subject_id string, slot string, value_type string, amount string, currency string, unit string, period string, context_quote string, recorded_at timestamp, base string, number double"
RATES = [("EUR", 1.0), ("CHF", 1.05), ("DEM", 0.5)]


@pytest.mark.parametrize("text,want", [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1'234.56", 1234.56), ("1 234,56", 1234.56), ("12", 12), ("0,5", 0.5), ("1.234.567", 1234567), ("2.8277", 2.8277), ("-3,10", -3.1)])
def test_number_formats(text, want):
    assert number(text)[0] == pytest.approx(want)


def test_a_single_mark_before_three_digits_has_two_readings():
    assert number("1.234") == (1234.0, 1.234)
    assert number("1.234", decimals_only=True) == (1.234, None)
    assert number("x") is None


@pytest.mark.parametrize("row,want", [
    (("€ 7.01 im Monat", None, None, None, None, True), (7.01, "EUR", 12)), (("2,8277 T€", None, None, None, None, True), (2827.7, "EUR", None)), (("594", "ct", None, "quarter", None, True), (5.94, "EUR", 4)),
    (("2,5", "EUR", None, None, "Angaben in Tsd. EUR", True), (2500, "EUR", None)), (("1000", "EUR", None, None, "zahlbar je Halbjahr", True), (1000, "EUR", 2)), (("35475Meilen", None, None, None, None, False), (35475 * 1.609344, "km", None)),
    (("12.17", None, None, None, "Einheit: GJ", False), (12.17 * 1000 / 3.6, "kWh", None)), (("427.5", None, "sq ft", None, None, False), (427.5 * 0.09290304, "m²", None)), (("439.6hl", None, None, None, None, False), (43.96, "m³", None)),
])
def test_reading(row, want):
    r = read(*row)
    assert (r.base, r.per_year) == want[1:] and r.value == pytest.approx(want[0])


def test_nothing_readable():
    assert read(None, "EUR", None, None, None, True) is None and read("k. A.", "EUR", None, None, None, True) is None and read("", None, None, None, None, False) is None
    assert recurrence("einmalig") is None


def test_changepoints_are_the_exact_optimum():
    rng = random.Random(4)
    for k in range(200):
        n = rng.randint(1, 10)
        x = np.log(np.array([rng.choice([100.0, 100.1, 120.0, 1000.0] if k % 2 else [100.0, 100.3, 100.6, 101.0, 101.4]) for _ in range(n)]))

        def cost(cuts):
            edges = [0, *cuts, n]
            return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() / (2 * units.NOISE**2) + units.PENALTY for a, b in zip(edges, edges[1:]))

        best = min(cost(c) for k in range(n) for c in itertools.combinations(range(1, n), k))
        seg = units.changepoints(x)
        assert cost([i for i in range(1, n) if seg[i] != seg[i - 1]]) == pytest.approx(best)


def test_a_large_step_is_cut_by_every_optimum():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = np.cumsum(rng.choice([0.0, 0.001, -0.001, 0.012, -0.015, 0.03], 300))
        whole = units.changepoints(x)
        starts = np.flatnonzero(np.concatenate([[True], np.abs(np.diff(x)) > units.CERTAIN]))
        seg, level = units._segments(x, starts)
        cost = lambda s: sum(((x[s == k] - x[s == k].mean()) ** 2).sum() / (2 * units.NOISE**2) + units.PENALTY for k in set(s))  # noqa: E731, B023
        assert len(starts) > 5 and cost(seg) == pytest.approx(cost(whole))
        assert level == pytest.approx([x[seg == k].mean() for k in seg])


def rows(spark, data):
    at = dt.datetime(2024, 1, 1)
    full = [(i, s, slot, kind, a, c, u, p, q, at + dt.timedelta(days=i), "clash", 1.0) for i, s, slot, kind, a, c, u, p, q in data]
    return spark.createDataFrame(full, SCHEMA)


def test_common_units_and_pairs(spark):
    data = [
        (1, "s", "balance", "money", "8.492,70", "EUR", None, None, None), (2, "s", "balance", "money", "849270", "EUR", None, None, None), (3, "s", "balance", "money", "16985.40", "DEM", None, None, None),
        (4, "s", "balance", "money", "9000,00", "EUR", None, None, None), (5, "s", "balance", "money", None, "EUR", None, None, None), (6, "s", "balance", "money", "n/a", None, None, None, None),
        (7, None, "balance", "money", "1,00", "EUR", None, None, None), (8, "z", "rent", "money", "0,00", "EUR", None, "month", None), (9, "z", "rent", "money", "0.00", "EUR", None, "year", None),
        (10, "z", "rent", "money", "100.00", "EUR", None, "month", None), (11, "z", "rent", "money", "1200", "CHF", None, "year", None), (12, "z", "name", "text", "5", None, None, None, None), (13, "z", "rent", "money", "5,00", "XXX", None, None, None),
    ]
    v = rows(spark, data)
    v = v.unionByName(v.filter("value_id = 1"))
    got = {r.value_id: r for r in units.common_units(v, spark.createDataFrame(RATES, "currency string, eur_per_unit double")).collect()}
    assert set(got) == set(range(1, 14)) - {12}
    assert got[2].amount_common == pytest.approx(8492.70) and got[2].reversed_factor == 100
    assert got[5].amount_common is None and got[6].amount_common is None and got[13].amount_common is None
    assert got[10].amount_common == pytest.approx(1200) and got[10].unit_common == "EUR/year" and got[11].amount_common == pytest.approx(1260)
    pairs = {tuple(r) for r in units.near_pairs(units.common_units(v, spark.createDataFrame(RATES, "currency string, eur_per_unit double"))).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (8, 9)}


def test_whole_amounts_with_decimals_state_their_scale(spark):
    data = [(1, "s", "charge", "money", "80.00", "EUR", None, None, None), (2, "s", "charge", "money", "8000", "EUR", None, None, None), (3, "s", "charge", "money", "80,00 Euro", None, None, None, None)]
    data += [(4, "t", "charge", "money", "80", "EUR", None, None, None), (5, "t", "charge", "money", "8000", "EUR", None, None, None), (6, "u", "bonus", "money", "1,074.00", "EUR", None, None, None), (7, "u", "bonus", "money", "107400", "EUR", None, None, None)]
    c = units.common_units(rows(spark, data), spark.createDataFrame(RATES, "currency string, eur_per_unit double"))
    assert {r.value_id: r.reversed_factor for r in c.collect() if r.reversed_factor} == {2: 100, 7: 100}
    assert {tuple(r) for r in units.near_pairs(c).collect()} == {(1, 2), (1, 3), (2, 3), (6, 7)}


@pytest.mark.parametrize("text,want", [("120.00", True), ("€ 506.00"[2:], True), ("1.074,00", True), ("1'074.00", True), ("2.8277", True), ("0.500", True), ("120", False), ("1.074", False), ("1.074.000", False), ("8 000", False)])
def test_decimals_by_the_written_form(text, want):
    assert has_decimals(text) is want


def test_a_whole_amount_beside_a_stated_one_keeps_its_level(spark):
    """Only the segment of several rows says that 120 is meant: alone, it would be minor units of the 1.20 further on."""
    amounts = ["120.00", "120", "120", "1.20", "1.20", "45000", "45000", "450.00"]
    data = [(i, "s", "charge", "money", a, "EUR", None, None, None) for i, a in enumerate(amounts)]
    c = units.common_units(rows(spark, data), spark.createDataFrame(RATES, "currency string, eur_per_unit double"))
    assert {r.value_id: r.reversed_factor for r in c.collect()} == {0: None, 1: None, 2: None, 3: None, 4: None, 5: 100, 6: 100, 7: None}


def test_other_factors_where_a_row_leaves_them_open(spark):
    data = [(1, "m", "rent", "money", "700,00", "EUR", None, "month", None), (2, "m", "rent", "money", "700.50", "EUR", None, None, None), (3, "m", "rent", "money", "70050", "EUR", None, None, None), (4, "m", "rent", "money", "15,00", "EUR", None, None, None)]
    data += [(5, "k", "mileage", "quantity", "15000", None, "km", None, None), (6, "k", "mileage", "quantity", "15000000", None, None, None, None), (7, "k", "mileage", "quantity", "9321", None, None, None, None), (8, "k", "mileage", "quantity", "77", None, None, None, None)]
    data += [(9, "w", "used", "quantity", "1,234", None, "m³", None, None), (10, "w", "used", "quantity", "1.2340", None, "m³", None, None), (11, "n", "used", "quantity", "5", None, None, None, None)]
    got = {r.value_id: r for r in units.common_units(rows(spark, data), spark.createDataFrame(RATES, "currency string, eur_per_unit double")).collect()}
    assert got[2].amount_common == pytest.approx(8406) and got[2].unit_common == "EUR/year" and got[3].amount_common == pytest.approx(8406)
    assert got[4].amount_common == 15 and got[4].unit_common == "EUR"
    assert got[6].amount_common == pytest.approx(15000) and got[6].unit_common == "km" and got[7].amount_common == pytest.approx(15000, rel=1e-3) and got[8].amount_common is None
    assert got[9].amount_common == pytest.approx(1.234) and got[9].reversed_factor == 1000 and got[11].amount_common is None


def test_one_long_history_under_any_batches_and_partitions(spark):
    """12 000 rows of one history in pieces of many rows, some as minor units: the same under any layout, and the truth."""
    rng, data, want = random.Random(3), [], {}
    for p in range(60):
        level = round(math.exp(rng.uniform(3, 7)), 2)
        minor = p % 5 == 2
        for i in range(200):
            n = p * 200 + i
            a = round(level * (1 + rng.uniform(-0.0004, 0.0004)), 2)
            stated = not minor and p != 0
            data.append((n, "s", "charge", "money", f"{a:.2f}" if stated or p == 0 else str(round(a * 100)), "EUR", None, None, None))
            want[n] = a
        if minor:  # The same level once more with decimals, elsewhere in the history.
            data.append((100_000 + p, "s", "charge", "money", f"{level:.2f}", "EUR", None, None, None))
            want[100_000 + p] = level
    v = rows(spark, data)
    rates = spark.createDataFrame(RATES, "currency string, eur_per_unit double")
    seen = set()
    for batch, parts in ((10_000, 4), (61, 9)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got = sorted((r.value_id, r.amount_common, r.reversed_factor or 0) for r in units.common_units(v, rates).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        seen.add(tuple(got))
    assert len(seen) == 1
    assert all(a == pytest.approx(want[i], rel=1e-4) for i, a, _ in next(iter(seen)))


def test_pairs_against_brute_force(spark):
    rng = random.Random(9)
    data = [(i, f"s{rng.randint(0, 2)}", "a", rng.choice([-1, 1]) * math.exp(rng.uniform(0, 0.06)), "EUR") for i in range(300)] + [(1000, "s1", "a", 0.0, "EUR"), (1001, "s1", "a", 0.0, "EUR")]
    d = spark.createDataFrame(data, "value_id long, subject_id string, slot string, amount_common double, unit_common string")
    got = [tuple(r) for r in units.near_pairs(d).collect()]
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[1] == b[1] and abs(a[3] - b[3]) <= 0.005 * max(abs(a[3]), abs(b[3]))}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    v = rows(spark, [])
    c = units.common_units(v, spark.createDataFrame(RATES, "currency string, eur_per_unit double"))
    assert c.count() == 0 and units.near_pairs(c).count() == 0
