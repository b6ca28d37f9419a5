import random

import numpy as np
import pytest

from factloom.llm import abuse as A


@pytest.mark.parametrize("text,want", [("V.o.l.l.i.d.i.o.t", "vollidiot"), ("D r e c k s a c k", "drecksack"), ("sc​umbag", "scumbag"), ("1d10t", "idiot"), ("V0ll1d10t", "vollidiot"), ("IMBÉCILE", "imbecile"), ("idiоt", "idiot"), ("crétiiiin", "cretiin"), ("am 12.03.2024", "am 12.03.2024"), ("12,50 €", "12,50 €")])
def test_disguises(text, want):
    assert A.plain(text) == want


def test_sentences_keep_everything():
    t = "Eins. Zwei! Drei\nvier " + "wort " * 400
    s = A.sentences(t)
    assert s[:4] == ["Eins.", "Zwei!", "Drei", "vier" + " wort" * 119] and all(len(x) <= A.LONGEST for x in s)
    marked = " ".join(f"w{i}" for i in range(3000))
    pieces = A.sentences(marked)
    # Nothing is lost, and any four words in a row lie within one piece.
    assert all(any(f"w{i} w{i + 1} w{i + 2} w{i + 3} " in p + " " for p in pieces) for i in range(2997))
    assert "".join(A.sentences("x" * 2000)).count("x") >= 2000
    assert A.sentences("") == [] == A.sentences(" \n ")


def corpus(n, seed):
    rng = random.Random(seed)
    good = ["Die Rechnung ist bezahlt.", "Bitte senden Sie den Vertrag.", "Der Kunde wurde als Idiot bezeichnet.", "Vielen Dank für die Nachricht.", "Der Zähler wurde abgelesen."]
    bad = ["Du bist ein {} Idiot.", "Halt dein Maul, du {} Trottel!", "Verschwinde, {} Idiot."]
    out = []
    for i in range(n):
        s = [rng.choice(good) for _ in range(rng.randint(2, 6))]
        y = int(rng.random() < 0.3)
        if y:
            s.insert(rng.randint(0, len(s)), rng.choice(bad).format(rng.choice(["elender", "dummer", "mieser"])))
        out.append((i, " ".join(s), y))
    return out


def test_learns_sentences_from_documents(spark):
    train, test = corpus(300, 1), corpus(200, 2)
    docs = spark.createDataFrame([(i, t, "a", 1.0) for i, t, _ in train] + [(1000 + i, t, "b", 1.0) for i, t, _ in test] + [(5000, None, None, 1.0), (5001, "", "b", 1.0), (5002, "Danke. " * 20_000, "b", 1.0)], "doc_id long, text string, source string, score double")
    flip = {i for i, *_ in train[:6]}
    labels = spark.createDataFrame([(i, "r", y ^ (i in flip), 0, 0) for i, _, y in train] + [(7, "r2", 0, 0, 0), (None, "r", 1, 1, 1)], "doc_id long, reviewer string, abusive int, hateful int, sexual int")
    got = {r.doc_id: r for r in A.scores(docs, labels).collect()}
    hit = [got[1000 + i].is_case == bool(y) for i, _, y in test]
    assert np.mean(hit) > 0.95 and len(got) == 503
    assert all(("Idiot" in got[1000 + i].sentence or "Trottel" in got[1000 + i].sentence) and "bezeichnet" not in got[1000 + i].sentence for i, _, y in test if y and got[1000 + i].is_case)
    assert got[5000].score == got[5001].score == 0 and got[5000].worst is None and not got[5002].is_case
    r = {x.source: x for x in A.rates(A.scores(docs, labels)).collect()}
    assert r[None].documents == 1 and r["b"].documents == 202


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, reviewer string, abusive int, hateful int, sexual int")
    assert A.scores(docs, none).first().score < 1e-6 and A.cases(A.scores(docs.limit(0), none)).count() == 0
