import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars, scanner
from factloom.operators import accounting, filters, graph, grounding, scan, search, timeline

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def brute_close(rows):
    out = {}
    for i, k, v, a in rows:
        later = [b for _, k2, v2, b in rows if k2 == k and a is not None and b is not None and v is not None and v2 is not None and b > a and v2 != v]
        out[i] = min(later) if later else None
    return out


def test_retimeline_against_brute_force_in_any_order(spark):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randint(0, 5)}", rng.choice(["a", "b", "c", None]), rng.choice([D(rng.randint(0, 9)), D(rng.randint(0, 9)), None])) for i in range(200)]
    want = brute_close(rows)
    for _ in range(2):
        rng.shuffle(rows)
        d = spark.createDataFrame(rows, "id int, k string, value string, valid_from date")
        got = {r.id: r.valid_to for r in timeline.retimeline(d, ["k"]).collect()}
        assert got == want


def test_conflicts_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["k", "l", None]), rng.choice("abc"), rng.choice([None, D(rng.randint(0, 20))]), rng.choice([None, D(rng.randint(21, 40))])) for i in range(60)]
    over = lambda x, y: (x[3] is None or y[4] is None or x[3] < y[4]) and (y[3] is None or x[4] is None or y[3] < x[4])
    want = {x[0] for x in rows for y in rows if x[1] == y[1] and x[2] != y[2] and over(x, y)}
    d = spark.createDataFrame(rows, "id int, k string, value string, valid_from date, valid_to date")
    assert {r.id for r in timeline.conflicts(d, ["k"], "id").collect()} == want


@pytest.mark.parametrize("kind,a,b,want", [("unknown", None, None, True), ("timeless", None, None, True), ("point", 5, None, True), ("point", 4, None, False), ("interval", 5, 6, True), ("interval", 4, 5, False), ("interval", 6, None, False), (None, 1, 9, False)])
def test_effective(spark, kind, a, b, want):
    d = spark.createDataFrame([(kind, a and D(a), b and D(b))], "k string, a date, b date")
    assert d.select(filters.effective(F.col("k"), F.col("a"), F.col("b"), F.lit(D(5)))).first()[0] is want


def test_resolution_statuses(spark):
    rows = [("m", "interval", "x", D(9), None), ("c", "interval", "x", D(0), None), ("c", "interval", "y", D(0), None), ("u", "unknown", "x", None, None), ("r", "timeless", "x", None, None)]
    d = spark.createDataFrame(rows, "k string, kind string, value string, valid_from date, valid_to date")
    assert {r.k: r.status for r in timeline.resolve(d, ["k"], F.lit(D(5))).collect()} == {"m": "missing", "c": "conflict", "u": "uncertain", "r": "resolved"}
    assert {r.k: r.status for r in timeline.resolve(d, ["k"], F.lit(D(5)), many=True).collect()}["c"] == "multiple"


@pytest.mark.parametrize("n,bad,want", [(19, 0, 0.8), (20, 0, 0.7), (20, 2, 0.8), (20, 3, 0.9)])
def test_threshold(spark, n, bad, want):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), 0.9, i < bad) for i in range(n)] + [(99, dt.datetime(2025, 1, 1), 0.1, True)]
    assert timeline.threshold(spark.createDataFrame(rows, "outcome_id int, recorded_at timestamp, confidence double, corrected boolean")).first().threshold == want


def test_chains_cycles_and_closure(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (None, 5)], "from_id long, into_id long")
    got = {r.from_id: r.into_id for r in graph.canonical(chain).collect()}
    assert got == {**{i: 50 for i in range(50)}, 100: 101}
    assert graph.closure(chain).filter("entity_id = 50").count() == 51
    with pytest.raises(ValueError):
        graph.canonical(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "from_id long, into_id long"))
    with pytest.raises(ValueError):
        graph.canonical(spark.createDataFrame([(i, i + 1) for i in range(200)], "from_id long, into_id long"))
    assert graph.canonical(chain.limit(0)).count() == 0


def test_context_bounds(spark):
    e = spark.createDataFrame([("a", f"b{i}") for i in range(10)] + [("b1", "c")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.context(e, s, 2).collect()} == {("a", 0), ("c", 2)} | {(f"b{i}", 1) for i in range(10)}
    cut = graph.context(e, s, 2, most=5).collect()
    assert len(cut) == 5 and all(r.truncated for r in cut)
    with pytest.raises(ValueError):
        graph.context(e, s, 5)


@pytest.mark.parametrize("text,want", [("007.50", "7.5"), ("-0.00", "0"), ("+12", "12"), ("1e3", None), ("1.", None), ("0.10", "0.1"), ("1200", "1200"), ("", None), (None, None)])
def test_canonical_decimal(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(scalars.canonical_decimal(F.col("x"))).first()[0] == want


def test_check_digits(spark):
    one = lambda e, x: spark.createDataFrame([(x,)], "x string").select(e(F.col("x"))).first()[0]
    assert one(scalars.valid_iban, "DE89 3704 0044 0532 0130 00") and not one(scalars.valid_iban, "DE88370400440532013000") and not one(scalars.valid_iban, None)
    assert one(scalars.valid_tax_id, "86 095 742 719") and not one(scalars.valid_tax_id, "86095742718") and not one(scalars.valid_tax_id, "11111111111")
    assert one(scalars.mrz_digit, "L898902C3") == 6 and one(scalars.mrz_digit, "740812") == 2
    assert scanner.iban_ok("DE89370400440532013000") and scanner.tax_ok("86095742719") and scanner.pension_ok("15070649C103")
    assert str(one(scalars.parse_date, "29.2.2024")) == "2024-02-29" and one(scalars.parse_date, "2023-02-29") is None


def test_candidates_are_slices_and_typed():
    text = "Rechnungsdatum: 12.03.2024\nBetrag: 1.234,56 € bis 3. April 2024\nIBAN DE89 3704 0044 0532 0130 00\nmail: a.b@example.org\n31.02.2024 5.6.24"
    got = scanner.scan(text)
    assert all(text[c.start : c.end] == c.text for c in got)
    kinds = {(c.kind, c.value) for c in got}
    assert {("date", "2024-03-12"), ("money", "1234.56"), ("date", "2024-04-03"), ("iban", "DE89370400440532013000"), ("email", "a.b@example.org")} <= kinds
    assert not any(c.kind == "date" and c.text.startswith(("31.02", "5.6")) for c in got)
    assert scanner.scan(None) == [] == scanner.scan("")


def test_scanner_holds_on_anything():
    rng = random.Random(7)
    alphabet = "AZaz09.,:-/€ \n\t@<ßüé😀​’'%"
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
        for c in scanner.scan(t):
            assert t[c.start : c.end] == c.text and c.kind in scanner.ORDER
    assert len(scanner.scan("Betrag: 1,00 €\n" * 500)) == scanner.MOST


def test_segments_join_to_the_text(spark):
    assert "".join(scan.cut("äöü\n" * 2000)) == "äöü\n" * 2000 and all(len(p.encode()) <= 1600 for p in scan.cut("ü" * 5000))
    d = spark.createDataFrame([(1, "x" * 4000), (2, None), (3, "")], "id long, text string")
    assert [r.ordinal for r in scan.segments(d, "id", "text").orderBy("ordinal").collect()] == [1, 2, 3]
    assert spark.createDataFrame([("A b\nc", "a  B\nnew\n")], "l string, o string").select(scan.new_lines(F.col("l"), F.col("o"))).first()[0] == ["new"]


def test_grounding(spark):
    how = lambda q, t: spark.createDataFrame([(q, t)], "q string, t string").select(grounding.grounded(F.col("q"), F.col("t"))).first()[0]
    assert how("12,50", "Summe 12,50 EUR") == "exact" and how("2,50", "Summe 12,50 EUR") is None and how("a b", "x a\n b y") == "spaced" and how("5", "-5") is None and how(None, "x") is None
    f = spark.createDataFrame([(1, "s", "12", "is 12", None), (2, "x", "12", "is 12", None), (3, "s", "13", "is 12", None), (4, "s", "12", "was 12", None), (5, "s", None, "is 12", None), (6, "s", "12", "is 12", "Bob"), (6, "s", "12", "is 12", "Bob")], "fact_id long, segment_id string, value string, quote string, subject_quote string")
    s = spark.createDataFrame([("s", "it IS\n12", 1)], "segment_id string, text string, value int")
    assert {r.fact_id: r.code for r in grounding.ground(f, s).collect()} == {1: "ok", 2: "no_segment", 3: "value_missing", 4: "quote_missing", 5: "no_value", 6: "subject_missing"}


def test_verdicts(spark):
    d = spark.createDataFrame([(0.8, 0.9), (0.1, 0.5), (0.1, 0.7), (0.1, 0.9), (None, None)], "f double, c double")
    assert [r[0] for r in d.select(grounding.band(F.col("f"), F.col("c"), F.lit(0.8))).collect()] == ["reject", "reject", "check", "accept", "reject"]
    c = spark.createDataFrame([(1, 10, "seg", 0, 5), (2, 11, "seg", 4, 9)], "id int, n int, segment_id string, start int, end int")
    s = spark.createDataFrame([("seg", 0, 6)], "segment_id string, start int, end int")
    assert [r.id for r in grounding.uncovered(c, s).collect()] == [2]


def test_search(spark):
    d = spark.createDataFrame([(1, "Mietvertrag Köln"), (2, "Miete und Heizung in koeln Köln"), (3, None), (4, "")], "id long, text string")
    index = search.index_of(d, "id", "text", "test_search")
    assert [r.id for r in search.search(index, "miet koln").collect()] == [1, 2]
    assert search.index_of(d, "id", "text", "test_search").terms.count() == index.terms.count() == 8


def test_reservation_replay(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.choice([None, 10, 60])) for i in range(60)]
    want, state = {}, {}
    for i, k, t in rows:
        n, left = state.get(k, (0, 200))
        ok = n < 5 and (t or 0) <= left
        want[i] = ok
        state[k] = (n + ok, left - (t or 0) * ok)
    got = accounting.reserve(spark.createDataFrame(rows, "i int, k string, t long"), "k", "i", "t", 5, 200)
    assert {r.i: r.granted for r in got.collect()} == want


def test_intake_and_export(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, None)], "id long, x string")
    assert {r.id: r.duplicate_of for r in accounting.intake(d, "id", F.col("x")).collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None}
    c = spark.createDataFrame([(i, "x" * 30) for i in range(10)], "seq long, payload string")
    assert [r.seq for r in accounting.export(c, 2, size=70).orderBy("seq").collect()] == [3, 4] and accounting.export(c, 2, size=5).count() == 1 and accounting.export(c, 99).count() == 0


def test_request_bounds():
    for bad in ({"query": "x" * 5000}, {"fields": 0}, {"limit": 31}, {"review_ids": 2000}):
        with pytest.raises(ValueError):
            filters.check_request(**bad)
    filters.check_request("ok", 3, 30, 5)


def test_conflicts_of_turned_and_open_intervals_against_brute_force(spark):
    rng = random.Random(11)
    data = [(i, rng.choice(["a", None]), rng.choice([None, *range(8)]), rng.choice([None, *range(8)]), rng.choice("xyz")) for i in range(120)]
    d = spark.createDataFrame(data, "id int, k string, valid_from int, valid_to int, value string")
    lo, hi = (lambda x: -1 if x is None else x), (lambda x: 99 if x is None else x)
    want = {p[0] for p in data for q in data if p[1] == q[1] and p[4] != q[4] and lo(p[2]) < hi(q[3]) and lo(q[2]) < hi(p[3])}
    assert {r.id for r in timeline.conflicts(d, ["k"], "id").collect()} == want


def test_a_key_of_very_many_intervals_ends(spark):
    """Squares of 100 000 intervals would not end: one value after the other, and one that overlaps its neighbours."""
    n = 100_000
    d = spark.range(n).selectExpr("id", "'k' k", "id * 10 valid_from", "id * 10 + if(id = 5000, 15, 10) valid_to", "cast(id as string) value")
    assert {r.id for r in timeline.conflicts(d, ["k"], "id").collect()} == {5000, 5001}
    closed = timeline.retimeline(d.drop("valid_to"), ["k"])
    assert closed.filter("valid_to = valid_from + 10").count() == n - 1


def test_clean_against_pairwise_rules():
    """The sweep keeps and labels what comparing every candidate with every other does."""
    from factloom.functions import scanner as sc

    rng = random.Random(6)
    kinds = list(sc.ORDER)
    for _ in range(150):
        found = []
        for _ in range(rng.randint(0, 14)):
            a = rng.randint(0, 25)
            found.append(sc.Candidate(rng.choice(kinds), "x", a, a + rng.randint(1, 9), 1, "x", rng.choice([None, None, "l1", "l2"]), rng.choice([None, True])))
        rank = {k: i for i, k in enumerate(sc.ORDER)}
        once = list({(c.start, c.end, c.kind): c for c in reversed(sorted(found, key=lambda c: (c.start, rank[c.kind], -c.end)))}.values())[::-1]
        spans = [(c.start, c.end) for c in once if c.kind not in sc.GENERIC]
        out, labels = [], {}
        for c in sorted(once, key=lambda c: (c.start, rank[c.kind], -c.end)):
            meets = any(a < c.end and c.start < b for a, b in spans)
            if c.kind in sc.GENERIC and c.kind != "cell" and meets:
                if c.label:
                    labels[c.start, c.end] = c.label
                continue
            if c.kind == "cell":
                labels.setdefault((c.start, c.end), c.label or "")
                if meets or any(a == c.start for a, _ in spans):
                    continue
            out.append(c)
        want = [c if c.label else c._replace(label=next((v for (a, b), v in labels.items() if v and a <= c.start and c.end <= b), None)) for c in out]
        assert sc.clean(found) == want


def test_search_of_a_stored_index(spark, tmp_path):
    from factloom.operators import search

    docs = spark.createDataFrame([(1, "Die Miete und die Heizung"), (2, "Mietvertrag, Heizungswartung, Miete"), (3, "nur Miete"), (4, None), (5, ""), (6, "x " * 400 + "HEIZÜNG miete " + "y " * 400)], "doc_id long, text string")
    search.write_index(docs, "doc_id", "text", str(tmp_path))
    index = search.read_index(spark, str(tmp_path))
    got = [(r.id, r.rank, r.more) for r in search.search(index, "miet heiz", 2).collect()]
    assert [g[0] for g in got] == [2, 1] and [g[1] for g in got] == [1, 2] and all(g[2] for g in got)
    hits = search.search(index, "heizung miete")
    assert {r.id for r in hits.collect()} == {1, 2, 6} and not hits.first().more
    e = {r.id: r.excerpt for r in search.excerpts(hits, docs, "doc_id", "text", "heizung").collect()}
    assert len(e[6]) == 500 and e[6][100:107] == "HEIZÜNG" and e[1] == "Die Miete und die Heizung"
    assert search.search(index, " ,; ").count() == 0 and search.search(index, "fehlt").count() == 0
    with pytest.raises(ValueError):
        search.search(index, "x" * 100_000)
    # Same scores as without the files.
    whole = search.Index(search.postings(docs, "doc_id", "text").withColumn("bucket", F.substring("term", 1, 1)), index.size)
    assert sorted(map(tuple, search.search(whole, "miet").collect())) == sorted(map(tuple, search.search(index, "miet").collect()))
    plan = search.search(index, "miet")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "StringStartsWith(term,miet)" in plan
