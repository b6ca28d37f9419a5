"""Queries keep the rows that their SQL leaves out; against brute force."""

import hashlib
import json

import __spark_entry__ as entry


def test_notes_with_a_combining_acute(spark, tmp_path):
    texts = {1: "Jose\u0301 Muster\nZeile e\u0301ins\nzwei", 2: "e\u0301" * 50 + "\nrest", 3: "ohne Zeile e\u0301", 4: "A\nB", 5: None, 6: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.title, r.body) for r in entry.queries()["v23_notes"](spark, str(tmp_path)).collect()}
    assert got == {k: (t.split("\n")[0][:60], t.partition("\n")[2]) for k, t in texts.items() if t is not None}


def test_keys_of_values_with_quotes_and_backslashes(spark, tmp_path):
    rows = [(1, "s", "name", "text", 'say "hi"', None), (2, "s", "path", "text", "a\\b", None), (3, "s", "id", "identifier", None, "DE/1"), (4, "s", "id", "identifier", None, None), (5, "s", "rent", "money", None, "5"), (6, "s", "name", "text", "Grüße", None)]
    spark.createDataFrame(rows, "value_id long, subject_id string, slot string, value_type string, value_text string, amount string").write.parquet(f"{tmp_path}/slot_values.parquet")
    got = {r.value_id: r.key for r in entry.queries()["v20_semantic_key"](spark, str(tmp_path)).collect()}
    key = lambda *c: hashlib.sha256(json.dumps({f"c{i}": x for i, x in enumerate(c)}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert got == {i: key(s, p, t or a) for i, s, p, kind, t, a in rows if kind != "money" and (t or a)}
