import pytest

from factloom.llm import encoding as E

WORDS = {"de": "für über können Fälligkeit Grüße Straße Höhe erhält Müller Prüfung März zuständige geprüft €00,00 €", "fr": "été réglé René déjà Échéance d’un reçu", "es": "señores más número García", "en": "café customer’s €000.00"}


@pytest.fixture(scope="module")
def judge():
    rows = [(k, w, 50) for k, ws in WORDS.items() for w in ws.split()]
    return E.Judge(E.select_entries(rows))


@pytest.mark.parametrize("wrong,right", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8"), ("cp437", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "cp1252"), ("cp850", "cp1252")])
def test_restores_wrong_readings(judge, wrong, right):
    text = "Bitte zahlen Sie die Miete für März über die Straße, können Sie das Prüfung und Höhe mit der Bank"
    bad = text.encode(right).decode(wrong)
    assert bad != text and judge.judge(bad)[1] == text


def test_twice_wrong_and_only_in_places(judge):
    text = "Sie können für die Höhe der Miete mit der Bank"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert judge.judge(twice)[1] == text
    assert judge.judge("Sie können fÃ¼r die Höhe")[1] == "Sie können für die Höhe"


@pytest.mark.parametrize("text", ["Sie können für die Höhe", "SÃO PAULO LIÇÃO MANHÃ", "João, ÂGE MINIMUM, Île-aux-Chênes", "Зоря Полеська, Łąkowa", "½ Zoll ± 0,5 √2 3ª Ø", "plain ascii", "Ärzte für Übungen"])
def test_proper_text_stays(judge, text):
    assert judge.judge(text) is None


def test_rows(spark):
    long = "Sie können für die Höhe der Miete " * 3000
    rows = [("a", "Sie kÃ¶nnen fÃ¼r die HÃ¶he", 1), ("b", "Sie k�nnen das", 1), ("c", None, 1), ("d", "", 1), ("e", "Sie können für die Höhe", 1), ("f", long.replace("für", "fÃ¼r"), 1), ("a", "Sie kÃ¶nnen fÃ¼r die HÃ¶he", 1)] + [(f"g{i}", "Sie können für die Höhe", 1) for i in range(5)]
    p = spark.createDataFrame(rows, "segment_id string, text string, chain int")
    f = spark.createDataFrame([(7, "fÃ¼r"), (8, None), (9, "ok")], "fact_id long, quote string")
    got = {(r.record_kind, r.record_id): r for r in E.found(p, f).collect()}
    assert set(got) == {("part", "a"), ("part", "b"), ("part", "f"), ("fact", "7")}
    assert got["part", "a"].restored == "Sie können für die Höhe" and got["part", "f"].restored == long and got["part", "b"].chain == "lost" and got["part", "b"].restored == "Sie können das"


def test_a_single_common_sign_passes_the_filter_and_syllables_stay(spark, judge):
    good, bad = "Sie können für die Höhe", ["f³r", "Der Auftrag ist f³r März", "dú", "der Preis 5 Ä"]
    p = spark.createDataFrame([(f"g{i}", good) for i in range(5)] + [("x", "die Auß-\nenwand")], "segment_id string, text string")
    f = spark.createDataFrame([(i, t) for i, t in enumerate(bad[:2])], "fact_id long, quote string")
    got = {(r.record_kind, r.record_id): r.restored for r in E.found(p, f).collect()}
    assert got == {("fact", "0"): "für", ("fact", "1"): "Der Auftrag ist für März"}
    held = spark.createDataFrame([(t,) for t in bad], "t string").filter(E.F.col("t").rlike(E.SUSPECT)).count()
    assert held == len(bad) and judge.judge("die Auß-\nenwand") is None


def test_filter_holds_for_all_that_a_chain_changes(spark):
    one = {chr(c) for e in E.NARROW for c in E._narrow(e)}
    two = {c.encode().decode(e, "ignore") for e in E.WIDE for c in E.LETTERS + E.SIGNS}
    texts = [t for t in sorted(one | two) if E.chains(t)]
    d = spark.createDataFrame([(f"x{t}x",) for t in texts], "t string")
    assert len(texts) > 500 and [r.t for r in d.filter(~E.F.col("t").rlike(E.SUSPECT)).collect()] == []


def test_empty(spark):
    assert E.found(spark.createDataFrame([], "segment_id string, text string"), spark.createDataFrame([], "fact_id long, quote string")).count() == 0
