import random

from pyspark.sql import functions as F

from factloom.operators import assembly, grounding


def test_batches_are_greedy(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), "x" * rng.choice([0, 5, 40, 120])) for i in range(80)] + [(99, None, "x"), (100, "c", None)]
    d = spark.createDataFrame(rows, "id long, g string, t string")
    want, state = {}, {}
    for i, g, t in rows:
        if g:
            k, used, held = state.get(g, (0, 0, 0))
            n = len(t or "")
            if held and (held >= 3 or used + n > 100):
                k, used, held = k + 1, 0, 0
            want[i] = k
            state[g] = (k, used + n, held + 1)
    assert {r.id: r.batch for r in assembly.batches(d, "id", "g", "t", 3, 100).collect()} == want
    salted = assembly.batches(d, "id", "g", "t", 3, 100, salts=4).groupBy("g", "batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()
    assert all(r.n <= 3 and (r.b <= 100 or r.n == 1) for r in salted) and sum(r.n for r in salted) == 81


def test_sections_share_a_row(spark):
    d = spark.createDataFrame([(i, "a", "x" * 40) for i in range(5)], "id long, g string, t string")
    got = {}
    for r in assembly.sections(d, "id", "g", "t", 100).collect():
        got.setdefault(r.section, set()).add(r.id)
    assert got == {0: {0, 1}, 1: {1, 2, 3}, 2: {3, 4}}


def test_contested(spark):
    d = spark.createDataFrame([(1, "s", 0.7), (2, "s", 0.9), (3, "s", 0.9), (4, "t", 0.5), (5, "u", None), (6, None, 0.9)], "id int, k string, confidence double")
    assert {r.id: (r.winner, r.n) for r in grounding.contested(d, ["k"], "id").collect()} == {1: (False, 3), 2: (True, 3), 3: (False, 3), 4: (False, 1), 5: (False, 1)}


def test_answers_and_typing(spark):
    d = spark.createDataFrame([([0.2, 0.8], 2), ([0.2, 0.8], 1), ([0.5, 0.6], 2), (None, 1)], "p array<double>, c int")
    assert [r[0] for r in d.select(assembly.valid_answer(F.col("p"), F.col("c"))).collect()] == [True, False, False, False]
    t = spark.createDataFrame([("date", " 1.2.2024 "), ("date", "31.2.2024"), ("identifier", "a-1 b"), ("money", "007.50"), ("text", " a  b "), ("text", None)], "k string, v string")
    assert [r[0] for r in t.select(assembly.typed(F.col("k"), F.col("v"))).collect()] == ["2024-02-01", None, "A1B", "7.5", "a b", None]


def test_retrieval_bounds(spark):
    rows = [(f"s{i}", f"d{i % 2}", q, i + 1) for q in range(3) for i in range(9)]
    got = assembly.retrieval(spark.createDataFrame(rows, "segment_id string, source_id string, query_no int, rank int"), per_query=4, per_source=2, most=3).orderBy("place").collect()
    assert [(r.segment_id, r.query_no) for r in got] == [("s0", 0), ("s1", 0), ("s2", 0)]
