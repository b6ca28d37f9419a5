import pytest

from factloom.llm import scan_noise as S

SCHEMA = "segment_id string, source_id string, vault string, ordinal int, text string, page int, section string, method string, defect string, key string"
BODY = "Sehr geehrte Damen und Herren,\nDie Rechnung wurde am Montag bezahlt und die Erklärung ist vollständig.\nBitte überweisen Sie den Betrag.\n"


def parts(spark, texts, source="q"):
    rows = [(f"s{i}", source, "v", i + 1, t, i + 1, None, None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def lex():
    forms = {w: 50 for w in "Rechnung Erklärung vollständig Betrag Montag Herren geehrte Damen Die und die wurde bezahlt Björn modern Haus Grundstück unterschriebene".split()}
    return S.Lexicon({**forms, "Rcchnung": 2}, {})


@pytest.mark.parametrize("word,meant", [("Rcchnung", "Rechnung"), ("Erk1ärung", "Erklärung"), ("vollsfändig", "vollständig"), ("Bjöm", "Björn"), ("Darnen", "Damen"), ("Griindstück", "Grundstück"), ("Griimdstück", None), ("Rechnung", None), ("RECHNUNG", None), ("unbekannt", None)])
def test_meant(lex, word, meant):
    assert lex.meant(word) == meant


@pytest.mark.parametrize("text,want", [("O8.01.2019", True), ("87,2S", True), ("20l9", True), ("MV-B6420251", True), ("12.03.2024", False), ("B98989031", False), ("1 I", False), ("kWh/m²", False), ("MV-41589711", False)])
def test_numbers(lex, text, want):
    assert (S.wrong_number(text) or any(lex.misread(w) for w in S._TOKEN.findall(text))) is want


@pytest.mark.parametrize("a,b,whole", [("die unterschrie-", "bene Erklärung", "unterschriebene"), ("die unterschrie¬ ", "  bene Erklärung", "unterschriebene"), ("die unterschrie­", "bene\r", "unterschriebene"), ("Die Haus-", "und Grundstückskosten", None), ("Küsthoff-", "Falkenloh", None), ("-", "Die", None), ("5-", "6", None)])
def test_split_words(lex, a, b, whole):
    assert S.split_words([a, b], lex).get(0) == whole


@pytest.mark.parametrize("line,page,own,rest", [("- 3 -", 3, True, ""), ("Seite 3 von 4", 3, True, ""), ("3/4", 3, True, ""), ("[3]", 3, True, ""), ("S. 4", 3, False, "S. 4"), ("X AG   S. 3", 3, True, "X AG"), ("X AG   3 | 6", 3, True, "X AG"), ("Talstraße 3", 3, False, "Talstraße 3"), ("page l", 1, True, "")])
def test_page_numbers(line, page, own, rest):
    assert S.page_number(line, page) == (own, rest)


def test_defects_of_a_source(spark):
    head = "MUSTER AG | Stadt\n"
    texts = [BODY + "page 1", head + BODY + "page 2", head + BODY.replace("Rechnung", "Rcchnung") + "page 3", head + BODY.replace("vollständig", "voll-\nständig"), None, ""]
    p = parts(spark, texts).unionByName(parts(spark, [BODY] * 30, "other").withColumn("segment_id", __import__("pyspark").sql.functions.concat(__import__("pyspark").sql.functions.lit("o"), "segment_id")))
    p = p.unionByName(p.filter("segment_id = 's1'"))
    got = {(r.segment_id, r.defect) for r in S.defects(p).filter("segment_id like 's%'").collect()}
    assert got == {("s0", "page_number"), ("s1", "page_number"), ("s1", "header"), ("s2", "page_number"), ("s2", "header"), ("s2", "chars"), ("s3", "header"), ("s3", "hyphen")}
    text = {r.segment_id: r.text for r in S.restored(p).filter("segment_id like 's%'").collect()}
    assert "MUSTER" not in text["s2"] and "page" not in text["s2"] and "Rechnung" in text["s2"] and "vollständig" in text["s3"] and text["s4"] is None and text["s5"] == ""


def test_empty(spark):
    assert S.defects(parts(spark, [])).count() == 0 and S.restored(parts(spark, [None])).count() == 1


def test_long_text(spark):
    p = parts(spark, ["wort " * 50_000 + "Ende"])
    assert S.defects(p).count() == 0 and len(S.restored(p).first().text) > 200_000


def test_the_word_before_decides(spark):
    """"modem" comes a twelfth as often as "modern": a misreading of it, but not where it stands again and again by itself."""
    lines = ["Das Haus ist modern gebaut."] * 120 + ["Wir liefern das modem morgen."] * 5
    texts = ["\n".join(lines), "Das Haus ist modem gebaut und gut.", "Wir liefern das modem morgen."]
    p = parts(spark, texts)
    got = {(r.segment_id, r.defect) for r in S.defects(p).collect()}
    assert ("s1", "chars") in got and ("s2", "chars") not in got
    assert {r.segment_id: r.text for r in S.restored(p).collect()}["s1"] == "Das Haus ist modern gebaut und gut."


def test_headers_with_running_numbers(spark):
    p = parts(spark, [f"Musterwerk AG | Rechnung {4700 + i} | 2024\n{BODY}{i} weitere\nEnde" for i in range(4)])
    got = {(r.segment_id, r.defect) for r in S.defects(p).collect()}
    assert {s for s, d in got if d == "header"} == {"s0", "s1", "s2", "s3"}
    other = parts(spark, [f"Musterwerk AG | Rechnung {n} | 2024\n{BODY}" for n in (4711, 9, 300)])
    assert not S.defects(other).filter("defect = 'header'").count()


def test_words_beyond_the_lexicon_are_judged_alike(spark):
    """With room for few forms, the join on skeletons finds what the whole lexicon finds."""
    texts = [BODY * 4 + "Vertragsnummer Kündigungsfrist Abrechnung\n" * 3, BODY.replace("Rechnung", "Rcchnung"), "Die Vcrtragsnummer fehlt.", "Kündigungsfrisf", "Abrechnung", "Ein Abrcchnung-Beleg"]
    p = parts(spark, texts)
    whole, few = ({tuple(r) for r in S.defects(p, most=m).collect()} for m in (S.MOST_FORMS, 3))
    assert whole == few and {("s1", "chars"), ("s2", "chars"), ("s3", "chars"), ("s5", "chars")} <= whole and ("s4", "chars") not in whole


def test_the_size_of_the_lexicon_changes_nothing(spark):
    """Rare words as the tasks do not hold them: places where they are proper, written with a hyphen, split, and chosen by the word before."""
    lines = ["Das Haus ist modern gebaut."] * 90 + ["Wir liefern das modem morgen."] * 5 + ["Ein Vor-ort Termin.", "Der Bauherr zahlt.", "Die Vcrtrag-Nummer fehlt.", "Der Vertrag endet."] * 3
    lines += ["Das liegt so fern davon."] * 4 + ["Hier steht die tern davon."] * 3
    rare = ["Wir liefern das modem morgen.", "Das Haus ist modem gebaut.", "Ein Vor-\nort Termin.", "Der Bau-\nHerr zahlt.", "Die Vcrtrag-Nummer fehlt.", "Der Vcrtrag endet.", "Hier steht die fcrn davon.", "Das liegt so fcrn davon."]
    p = parts(spark, [BODY * 90 + "\n".join(lines), *rare])
    found, texts = ({m: {tuple(r) for r in f(p, most=m).collect()} for m in (S.MOST_FORMS, 20, 3, 0)} for f in (S.defects, S.restored))
    assert {x for x in found[S.MOST_FORMS] if x[0] != "s0"} == {("s2", "chars"), ("s4", "hyphen"), ("s6", "chars"), ("s7", "chars"), ("s8", "chars")}
    whole = dict(texts[S.MOST_FORMS])
    assert [whole[f"s{i}"] for i in (1, 2, 6, 7, 8)] == [rare[0], "Das Haus ist modern gebaut.", "Der Vertrag endet.", "Hier steht die tern davon.", "Das liegt so fern davon."]
    assert all(x == found[S.MOST_FORMS] for x in found.values()) and all(x == texts[S.MOST_FORMS] for x in texts.values())


def test_strokes_of_a_column(spark):
    words = ["Rechnung", "modern", "Übung", "WIDERRUF", "ß8B", "häufig", "1|l", ""]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in d.select(S._strokes(d.w)).collect()] == [S.skeleton(w) for w in words]
