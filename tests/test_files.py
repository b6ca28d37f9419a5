import io
import zipfile
from email.message import EmailMessage

from factloom.sources import files


def docx(xml):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", xml)
    return b.getvalue()


def test_parsers(spark, tmp_path):
    w = 'xmlns:w="w"'
    body = f"<w:document {w}><w:p><w:t>one</w:t></w:p><w:p><w:del><w:t>gone</w:t></w:del><w:t>two</w:t></w:p></w:document>"
    m = EmailMessage()
    m["From"], m["Subject"] = "a@example.org", "Hi"
    m.set_content("plain text")
    m.add_alternative("<p>plain</p> <p>text</p>", subtype="html")
    m.add_attachment(b"attached", maintype="text", subtype="plain", filename="n.txt")
    (tmp_path / "sub").mkdir()
    for name, data in {"a.txt": "﻿über".encode(), "b.html": b"<style>x</style><p>A&amp;B</p><tr><td>1</td><td>2</td></tr>", "c.docx": docx(body), "d.eml": m.as_bytes(), "bad.docx": b"zip", "e.txt": b"a\0b", "sub/.hidden.txt": b"x", "z.exe": b"x", "empty.md": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = files.files(spark, str(tmp_path))
    rows = {}
    for r in files.documents(got).collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert rows["a.txt"][0].text == "über" and rows["b.html"][0].text.splitlines()[0] == "A&B" and rows["c.docx"][0].text == "one\ntwo"
    assert [(r.section, r.text) for r in rows["d.eml"]][1:] == [("body", "plain text"), ("attachment n.txt", "attached")]
    assert rows["bad.docx"][0].error and rows["e.txt"][0].error and "empty.md" not in rows
    assert {r.path.rsplit("/", 1)[1] for r in files.plan_folder(got, str(tmp_path)).filter("verdict = 'take'").collect()} == {"a.txt", "b.html", "c.docx", "d.eml", "bad.docx", "e.txt"}


def test_plan(spark):
    sizes = {"a.txt": 5, "sub/.hidden.txt": 5, "z.exe": 5, "empty.md": 0, "big.pdf": 65 << 20, "/".join("x" * 33) + "/d.txt": 5, "noext": 5}
    d = spark.createDataFrame([(f"file:/root/in/{k}", n) for k, n in sizes.items()], "path string, length long")
    got = {r.path.removeprefix("file:/root/in/"): r.verdict for r in files.plan_folder(d, "/root/in").collect()}
    assert list(got.values()) == ["take", "hidden", "unsupported", "empty", "large", "deep", "unsupported"]


def test_document_types_are_refused():
    import pytest

    with pytest.raises(ValueError):
        files.docx(docx('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'))
