import math

import pytest

from factloom.llm import mixing as M


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_entropy_is_met():
    w, a = M.entropy_weights({"a": 900, "b": 90, "c": 10}, 0.8)
    assert M.entropy(w) == pytest.approx(0.8, abs=1e-6) and 0 < a < 16 and sum(w.values()) == pytest.approx(1)
    assert M.entropy(M.entropy_weights({"a": 900, "b": 100}, 9.0)[0]) == pytest.approx(math.log(2))


def test_weights_keep_the_limits():
    w, a, n = M.target_weights({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    assert (a, n) == (1.0, 600) and w == pytest.approx({"a": 0.5, "b": 0.5})
    w, a, n = M.target_weights({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, budget=1000)
    assert n == 1000 and 0 < a < 1 and w["b"] * n <= 300 + 1e-3
    assert M.target_weights({}, {"a": 1.0}, {"a": 1}) == ({}, 1.0, 0)


def test_shares_and_repeats(spark):
    rows = [(i, "big", 10) for i in range(3000)] + [(10_000 + i, "small", 7) for i in range(200)] + [(20_000 + i, "free", 5) for i in range(50)] + [(1, "big", 10)] + [(30_000, "small", 0)]
    t = targets(spark, [("big", 0.6, 1), ("small", 0.2, 3), ("gone", 0.2, 4), (None, 0.1, 1)])
    chosen, report = M.mix(sizes(spark, rows), t)
    c = chosen.collect()
    assert len({r.doc_id for r in c}) == len(c) and {r.source for r in c} == {"big", "small"}
    r = {x.source: x for x in report.collect()}
    assert r["gone"].actual_tokens == 0 and abs(r["big"].actual_share - 0.75) < 0.01 and abs(r["small"].actual_share - 0.25) < 0.01
    assert r["small"].repeats <= 3 and r["big"].repeats <= 1
    assert r["big"].actual_tokens == sum(x.n_tokens * x.repeats for x in c if x.source == "big") <= r["big"].budget_tokens


def test_report_has_sources_of_either_side(spark):
    rows = [(i, "a", 10) for i in range(20)] + [(100 + i, "free", 5) for i in range(4)] + [(100, "free", 3), (200, None, 9)]
    chosen, report = M.mix(sizes(spark, rows), targets(spark, [("a", 0.7, 2), ("gone", 0.3, 1)]))
    got = {r.source: (r.target_share, r.max_repeats, r.weight, r.source_tokens, r.actual_tokens, r.actual_share) for r in report.collect()}
    assert got == {"a": (0.7, 2, 1.0, 200, 400, 1.0), "gone": (0.3, 1, 0.0, 0, 0, 0.0), "free": (None, None, 0.0, 20, 0, 0.0)}
    assert {r.source for r in chosen.collect()} == {"a"}


def test_same_every_time_and_empty(spark):
    s, t = sizes(spark, [(i, "a", i % 9) for i in range(500)]), targets(spark, [("a", 1.0, 2)])
    rows = lambda d: sorted(map(tuple, M.mix(d, t, budget=700)[0].collect()))
    assert rows(s) == rows(s.repartition(3))
    chosen, report = M.mix(s.limit(0), t)
    assert chosen.count() == 0 and report.first().actual_share == 0.0


def test_long_documents_do_not_end_a_block(spark):
    rows = [(1, "a", 5000), (2, "a", 4000)] + [(10 + i, "a", 3) for i in range(400)] + [(1000 + i, "b", 10) for i in range(500)] + [(5000, "c", 900)]
    t = targets(spark, [("a", 0.45, 2), ("b", 0.45, 1), ("c", 0.1, 2)])
    for budget in (3000, 6000, 9500):
        chosen, report = M.mix(sizes(spark, rows), t, budget=budget)
        r = {x.source: x for x in report.collect()}
        c = chosen.collect()
        assert len({x.doc_id for x in c}) == len(c)
        assert all(x.actual_tokens <= x.budget_tokens for x in r.values()) and r["b"].budget_tokens - r["b"].actual_tokens < 10
        # The long ones that fit are in; what they leave is filled with short ones as far as these go.
        short = 1200 * (1 + r["a"].budget_tokens // 10200)
        assert r["a"].actual_tokens >= min(r["a"].budget_tokens, short) - 3


def test_entropy_mix_reports_a_bisected_exponent(spark):
    rows = [(i, "a", 10) for i in range(900)] + [(5000 + i, "b", 10) for i in range(90)] + [(8000 + i, "c", 10) for i in range(10)]
    t = targets(spark, [("a", 0.5, 4), ("b", 0.3, 4), ("c", 0.2, 4)])
    goal = M.entropy({"a": 0.5, "b": 0.3, "c": 0.2})
    r = {x.source: x for x in M.mix(sizes(spark, rows), t, target_entropy=goal)[1].collect()}
    assert M.entropy({k: x.weight for k, x in r.items()}) == pytest.approx(goal, abs=1e-6) and 0 < r["a"].exponent < 1
    assert all(x.repeats <= 4 for x in r.values()) and all(abs(x.actual_share - x.weight) < 0.02 for x in r.values())
    assert M.mix(sizes(spark, []), t, target_entropy=goal)[0].count() == 0
