import pytest

from factloom.llm import names as N


@pytest.mark.parametrize("a,b", [("Müller", "Mueller"), ("MÜLLER", "muller"), ("René", "Rene"), ("Weiß", "Weiss")])
def test_fold(a, b):
    assert N.fold(a) == N.fold(b)


@pytest.mark.parametrize("short,full,want", [("spbk", "sparbank", True), ("hv", "hausverwaltung", True), ("elektro", "elektrotechnik", True), ("log", "logistik", True), ("wohnungsbau", "wohnbau", True), ("kk", "sparbank", False), ("beratung", "sparbank", False)])
def test_abbreviations(short, full, want):
    assert N.abbreviates(short, full) is want


def table(spark, rows):
    return spark.createDataFrame(rows, "vault string, name string, login boolean, n long")


def linked(spark, rows):
    got = {}
    for r in N.entities(table(spark, rows)).collect():
        got.setdefault((r.vault, r.entity), set()).add(r.name)
    return sorted(map(sorted, got.values()))


def test_variants_of_people(spark):
    same = ["Francisco Hageler", "Hageler, Francisco", "FRANCISCO HAGELER", "Paco Hageler", "Francsico Hageler", "Francisco Hagler", "Herr Francisco Hageler", "Hageler, F.", "Francisco T. Hageler"]
    other = ["Christina Hageler", "Tina Hageler", "C. Hageler"]
    rows = [("v", n, False, 20 if i == 0 else 1) for i, n in enumerate(same)] + [("v", n, False, 9 if i == 0 else 1) for i, n in enumerate(other)]
    rows += [("v", "francisco.hageler@x.example", True, 1), ("v", "fhageler", True, 1), ("v", "admin", True, 1), ("v", "kd-1234", True, 1), ("v", "Kunde", False, 5), ("v", "Fam. Hageler", False, 1), ("v", "unbekannt", False, 3)]
    got = linked(spark, rows)
    assert sorted([*same, "francisco.hageler@x.example", "fhageler"]) in got and sorted(other) in got and len(got) == 2


def test_organisations_and_vaults(spark):
    rows = [("v", "Nordhalm Sparbank GmbH", False, 9), ("v", "Nordhalm Spbk. GmbH", False, 1), ("v", "NORDHALM SPARBANK", False, 1), ("v", "Fa. Nordhalm Sparbank", False, 1), ("v", "Nordhlam Sparbank Gesellschaft mbH", False, 1), ("v", "Nordhalm Logistik GmbH", False, 4), ("w", "Nordhalm Sparbank GmbH", False, 4)]
    rows += [(f"u{i}", "Ostmark Sparbank AG", False, 3) for i in range(5)]
    got = linked(spark, rows)
    assert sorted(n for v, n, *_ in rows if v == "v" and "Logistik" not in n) in got and ["Nordhalm Logistik GmbH"] in got and ["Nordhalm Sparbank GmbH"] in got


def test_pairs_nulls_and_empty(spark):
    c = spark.createDataFrame([("v", "Anna Muster", 1), ("v", "Anna Muster", 1), ("v", None, 1), ("v", " ", 1), (None, "Anna Muster", 1), ("v", "Muster, Anna", 1)], "vault string, subject_name string, name int")
    f = spark.createDataFrame([("v", "x" * 5000), ("v", "ANNA MUSTER")], "vault string, subject_quote string")
    l = spark.createDataFrame([("v", "anna.muster"), ("v", "")], "vault string, username string")
    got = {tuple(r) for r in N.pairs(N.entities(N.spellings(c, f, l))).collect()}
    s = sorted(["ANNA MUSTER", "Anna Muster", "Muster, Anna", "anna.muster"])
    assert got == {("v", a, b) for i, a in enumerate(s) for b in s[i + 1 :]}
    assert N.pairs(N.entities(N.spellings(c.limit(0), f.limit(0), l.limit(0)))).count() == 0


def test_names_of_their_own_stay_apart(spark):
    rows = [("v", "Hans Maier", False, 1000), ("v", "Hans Meier", False, 900), ("w", "Hans Maier", False, 50), ("w", "Hans Mbier", False, 1)]
    assert linked(spark, rows) == [["Hans Maier"], ["Hans Maier", "Hans Mbier"], ["Hans Meier"]]


def test_no_link_is_lost(spark):
    assert linked(spark, [("v", "Marie-Luise Huber", False, 5), ("v", "Marieluise Huber", False, 1)]) == [["Marie-Luise Huber", "Marieluise Huber"]]
    # A chain of ten, each a typo of the one before.
    word, chain = list("abcdefghijklm"), []
    for i in range(10):
        word[i] = "z"
        chain.append(("v", f"Anna {''.join(word).capitalize()}", False, 3 ** (9 - i)))
    assert linked(spark, chain) == [sorted(n for _, n, *_ in chain)]


def test_followed_links_end(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(200, 201), (201, 200), (202, 201), (300, 301), (301, 302), (302, 300), (303, 302), (304, 303)], "v long, c long").selectExpr("*", "0.0 own")
    got = {r.v: r.entity for r in N._ends(d).collect()}
    assert {got[i] for i in range(1, 70)} == {70} and got[200] == got.get(201, 201) == got[202] and len({got[i] for i in range(300, 305)}) == 1


def test_evidence():
    assert N.evidence(1, 1) == N.evidence(1, 500) == 0 and N.evidence(900, 1000) < -5 < N.evidence(2, 2)
